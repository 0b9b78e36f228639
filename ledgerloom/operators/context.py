"""Who asks, kept in session variables: views that filter themselves, and changes that know their author.

The variables are declared once per session; a view made by ``protect`` reads
them when a query on it is analysed, so the condition is folded to a literal and
reaches the scan like any other filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Roles that may read everything.
READ_ALL = ("controleur", "admin")
_VARIABLES = {"role_courant": "STRING", "organisation_courante": "BIGINT", "motif_courant": "STRING", "auteur_courant": "STRING"}


def declare(spark: SparkSession) -> None:
    """Declare the session's variables (nobody, no reason) and its function ``peut_lire``."""
    for name, kind in _VARIABLES.items():
        spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind} DEFAULT NULL")
    roles = ", ".join(f"'{r}'" for r in READ_ALL)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION peut_lire(role STRING, sienne BIGINT, organisation BIGINT) RETURNS BOOLEAN
        RETURN coalesce(role IN ({roles}), false) OR coalesce(role = 'operateur' AND organisation = sienne, false)""")


def act_as(spark: SparkSession, role: str | None = None, organisation: int | None = None, motif: str | None = None, author: str | None = None) -> None:
    """Set who asks from here on in this session."""
    for name, value in zip(_VARIABLES, (role, organisation, motif, author)):
        spark.sql(f"SET VARIABLE {name} = :v", args={"v": value})


def protect(df: DataFrame, name: str, column: str = "organisation_id") -> None:
    """Register ``df`` as a view of which everybody sees what they may read."""
    spark = df.sparkSession
    df.createOrReplaceTempView(f"{name}_sans_filtre")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM {name}_sans_filtre WHERE peut_lire(session.role_courant, session.organisation_courante, CAST({column} AS BIGINT))")


def reason() -> Column:
    """The reason for changes, empty when absent."""
    return F.expr("coalesce(session.motif_courant, '')")


def author() -> Column:
    return F.expr("coalesce(session.auteur_courant, '')")
