"""URL filters: rules first, then a tree of path templates per host.

A rule (host, path, verdict) fits its host and all subdomains, if the url's path
starts with the rule's; the longest fitting rule decides, and what it decides is
a label for the method.  Urls that no rule fits are judged by their template:

* Segments are generalised by form: digit runs become ``{n}``, hexadecimal keys
  ``{x}``, segments of more than 64 characters ``{long}``.
* Level by level, from the host down, a node with more than ``most_children``
  different segments (or mostly different ones) has a wildcard ``{*}`` as its
  child.  Any other node's children, ``most_children`` at most, are merged where
  neither what follows them nor their labels tells them apart (chi-square tests;
  differences below ``tolerance`` count as none, however many urls show them).  A
  branch without labels joins labelled ones only if they agree; it stays by
  itself if it resembles branches of opposite labels.
* A node's purity is its share of allowed urls among labelled ones, smoothed
  towards its parent's: (allowed + smoothing * parent) / (labelled + smoothing),
  the host's towards that of all hosts.  Templates of a purity below
  ``least_purity`` are rejected.

The tree lives in tables: urls are counted by host and form before anything
else, a level is two aggregations and a join over these counts, and what is
merged in Python is one node's list of ``most_children`` entries.  Hosts and
templates may hold any share of all rows (``skew.join_counted``).  The template
describes the first ``depth`` segments; urls of any length are judged.

A null url, or one without ``://``, has empty host and path.  Repeated rows and
rows with a null id are each judged; extra columns are ignored, whatever their
names; an empty table gives an empty result.  Without rules there are no labels,
so every purity is one half and all is allowed.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.skew import join_counted
from ledgerloom.session import discard, materialise, ship_package

Rule = tuple[str, str, str]
WILDCARD, LONG = "{*}", "{long}"
CLASSES = 6  # of what may follow a segment: nothing, number, holding one, key or long, compound, word


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest one is asked first
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segment_forms(path: Column, depth: int) -> Column:
    """The first ``depth`` segments that are not empty, with their variable parts generalised."""

    def form(segment: Column) -> Column:
        keyless = F.regexp_replace(segment, r"(?<![0-9A-Za-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?![0-9A-Za-z])", "{x}")
        return F.when(F.length(segment) > 64, F.lit(LONG)).otherwise(F.regexp_replace(keyless, r"[0-9]+", "{n}"))

    return F.transform(F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, depth), form)


def _class_of(segment: Column) -> Column:
    return (
        F.when(segment.isNull(), 0).when(segment == "{n}", 1).when(segment.contains("{n}"), 2).when(segment.contains("{x}") | (segment == LONG), 3)
        .when(segment.rlike("[-_.]"), 4).otherwise(5)
    )


def alike(one: list[int], other: list[int], tolerance: float, z: float = 2.326) -> bool:
    """Whether two tables of counts may come from one distribution.

    Chi-square of homogeneity at the level of ``z`` (one in a hundred), by the
    cube-root approximation; shares that differ by ``tolerance`` at most in
    total are alike anyway, and so are counts of which one is empty.
    """
    n, m = sum(one), sum(other)
    if not n or not m:
        return True
    if sum(abs(a / n - b / m) for a, b in zip(one, other)) / 2 <= tolerance:
        return True
    used = [(a, b) for a, b in zip(one, other) if a + b]
    freedom = len(used) - 1
    statistic = sum((a * m - b * n) ** 2 / (a + b) for a, b in used) / (n * m)
    return statistic <= freedom * (1 - 2 / (9 * freedom) + z * math.sqrt(2 / (9 * freedom))) ** 3


def merge_children(children: list[dict], tolerance: float) -> dict[str, str]:
    """The template segment of each child: its own, or ``{a|b}`` for those merged with it.

    Children are dicts of ``child``, ``n``, ``good``, ``bad`` and ``next`` (counts
    of what follows, by class).  The one that ends here (empty) stays alone.
    """
    def joined(group: dict, c: dict) -> None:
        group["names"].append(c["child"])
        for key in ("next", "labels"):
            group[key] = [a + b for a, b in zip(group[key], c[key] if key == "next" else (c["good"], c["bad"]))]

    def started(c: dict) -> dict:
        return {"names": [c["child"]], "next": list(c["next"]), "labels": [c["good"], c["bad"]]}

    order = sorted((c for c in children if c["child"]), key=lambda c: (-c["n"], c["child"]))
    labelled: list[dict] = []
    for c in order:
        if c["good"] + c["bad"]:
            fit = next((g for g in labelled if alike(g["next"], c["next"], tolerance) and alike(g["labels"], [c["good"], c["bad"]], tolerance)), None)
            joined(fit, c) if fit else labelled.append(started(c))
    unlabelled: list[dict] = []
    taken: list[tuple[dict, str]] = []
    for c in order:
        if not c["good"] + c["bad"]:
            fits = [g for g in labelled if alike(g["next"], c["next"], tolerance)]
            if len(fits) == 1:
                taken.append((fits[0], c["child"]))
                continue
            fit = next((g for g in unlabelled if alike(g["next"], c["next"], tolerance)), None)
            joined(fit, c) if fit else unlabelled.append(started(c))
    for group, name in taken:  # only now, so that they don't move what others are held against
        group["names"].append(name)
    out = {"": ""} if any(not c["child"] for c in children) else {}
    for group in labelled + unlabelled:
        names = sorted(group["names"])
        out.update({name: names[0] if len(names) == 1 else "{" + "|".join(names) + "}" for name in names})
    return out


def _merged(tolerance: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [merge_children(kids.as_py(), tolerance) for kids in batch.column(1)]
            labels = pa.array([list(f.items()) for f in found], pa.map_(pa.string(), pa.string()))
            yield pa.record_batch([batch.column(0), labels], names=["node", "labels"])

    return work


def templates(counted: DataFrame, depth: int, most_children: int, smoothing: float, least_labels: float, tolerance: float) -> DataFrame:
    """Template and purity of every (``key``, ``host``, ``segs``, ``n``, ``good``, ``bad``)."""
    facts = counted.agg(F.count("*"), F.sum("good"), F.sum("bad")).first()
    total, good, bad = facts[0], facts[1] or 0, facts[2] or 0
    prior = (good + smoothing * least_labels) / (good + bad + smoothing)
    active = counted.withColumns({"node": F.col("host"), "p": F.lit(prior)})
    finished: list[DataFrame] = []
    written: list[DataFrame] = []
    for level in range(depth + 2):
        after = _class_of(F.get("segs", F.lit(level + 1)))
        kids = active.groupBy("node", "p", F.coalesce(F.get("segs", F.lit(level)), F.lit("")).alias("child")).agg(
            F.count("*").alias("leaves"), *(F.sum(c).alias(c) for c in ("n", "good", "bad")), F.array(*(F.sum(F.when(after == c, F.col("n")).otherwise(0)) for c in range(CLASSES))).alias("next"))
        kids = materialise(kids, f"urls-children-{level}")
        nodes = kids.groupBy("node").agg(
            F.count("*").alias("rows"), F.sum("leaves").alias("leaves"), F.count_if(F.col("child") != "").alias("different"), F.sum("n").alias("n"),
            ((F.sum("good") + smoothing * F.max("p")) / (F.sum("good") + F.sum("bad") + smoothing)).alias("purity"), (F.sum("good") + F.sum("bad")).alias("labelled"))
        nodes = nodes.withColumn("wide", (F.col("different") > most_children) | (F.col("n") >= 10) & (F.col("different") * 2 > F.col("n")))
        nodes = materialise(nodes, f"urls-nodes-{level}")
        narrow = join_counted(kids, nodes.filter(~F.col("wide")).select("node", "rows", F.lit(True).alias("narrow")), "node", kids.count()).filter("narrow")
        lists = narrow.groupBy("node").agg(F.collect_list(F.struct("child", "n", "good", "bad", "next")).alias("kids"))
        merged = lists.mapInArrow(_merged(tolerance), "node string, labels map<string,string>")
        decided = nodes.drop("rows", "n").withColumnRenamed("leaves", "rows").join(merged, "node", "left")
        decided = materialise(decided, f"urls-decided-{level}")
        child = F.coalesce(F.get("segs", F.lit(level)), F.lit(""))
        label = F.when(child == "", "").when(F.col("wide"), WILDCARD).otherwise(F.col("labels")[child])
        step = materialise(join_counted(active, decided, "node", total).select(
            "key", "host", "segs", "n", "good", "bad", F.col("node").alias("at"), F.concat_ws("/", "node", label).alias("node"), F.col("purity").alias("p"), "labelled"), f"urls-level-{level}")
        for table in (kids, nodes, decided):
            discard(table)
        written.append(step)
        # A url whose segments ended one level above has now the purity of its own end.
        over = F.size("segs") < level
        finished.append(step.filter(over).select("key", F.col("n").alias("rows"), F.col("at").alias("template"), F.col("p").alias("purity"), "labelled"))
        active = step.filter(~over).drop("at", "labelled")
        if active.isEmpty():
            break
    found = finished[0]
    for part in finished[1:]:
        found = found.unionByName(part)
    found = materialise(found, "urls-templates")
    for table in written:
        discard(table)
    return found


def judge(
    pages: DataFrame,
    rules: list[Rule],
    depth: int = 8,
    most_children: int = 20,
    smoothing: float = 4.0,
    least_purity: float = 0.3,
    tolerance: float = 0.1,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Every page's ``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity`` and ``labelled`` (labelled urls of the template).

    Rules are a short list, asked one after the other; a rule's host is held
    against the url's as it stands, with A-Z lower-cased.
    """
    ship_package(pages.sparkSession)
    low = [(name.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), start, verdict) for name, start, verdict in rules]
    host, path = host_and_path(F.col("u"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("u")).select("id", host.alias("host"), path.alias("path"))
    urls = urls.withColumns({"by": rule_of(F.col("host"), F.col("path"), low), "segs": segment_forms(F.col("path"), depth)})
    urls = urls.withColumn("key", F.concat_ws("/", "host", F.array_join("segs", "/")))
    counted = urls.groupBy("key").agg(
        F.first("host").alias("host"), F.first("segs").alias("segs"), F.count("*").alias("n"), F.count_if(F.col("by.verdict") == "allow").alias("good"), F.count_if(F.col("by.verdict") == "block").alias("bad"))
    counted = materialise(counted, "urls-counted")
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = templates(counted, depth, most_children, smoothing, 0.5, tolerance)
    discard(counted)
    judged = join_counted(urls, found, "key", total)
    verdict = F.coalesce(F.col("by.verdict"), F.when(F.col("purity") < least_purity, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), "template", "purity", "labelled")
