"""URL filter rules by a sort-merge range join.

A rule is (host, path, verdict).  It fits a url whose host is the rule's or a subdomain of it and
whose path starts with the rule's; of the rules that fit, the longest decides.

A canonical key is the host with its labels reversed, a slash, and the path: the urls that a rule
fits at one level of their host are the keys that start with the rule's key, one interval of the
sort order.  Each different url probes its host and each parent of it.  Probes and rules are dealt
to ranges of the key order and sorted; a sweep keeps the stack of rules whose interval is open,
each nested in the one below, so the innermost is on top.  A rule enters all ranges its interval
touches.  Range limits come from a bounded sample and include a salt, so that one key held by many
urls is split as well.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarch.llm.common import column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLE = 4096  # keys of the sample for the range limits
SAMPLE_CHARS = 256  # of each; a limit is a place in the order, not a key
_FIELDS = "part int, key binary, kind int, host string, path string, rule string, verdict string"


def url_host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' without '://'."""
    return F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to '?', '#' or the end."""
    rest = _rest(url)
    return F.regexp_extract(F.regexp_replace(rest, r"\A[^/?#]*", ""), r"\A[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path)


def parse_rule(rule: str, verdict: str) -> tuple[str, str, str]:
    """A rule such as 'example.org/es/' as (host, path, verdict)."""
    host, slash, path = rule.partition("/")
    return host, slash + path, verdict


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page row: id, host, path, rule (null if none fits), verdict.

    `rules` has host, path and verdict (strings).  Length is counted in characters of host and
    path together; of two equally long ones the longer host decides, and of two verdicts for one
    rule the later in the alphabet (block before allow).  Rules with a null field take no part.
    A null url or one without '://' has host and path '' and the default verdict.  Null and
    repeated ids are kept; other columns are ignored; without rules every verdict is the default.
    """
    spark = pages.sparkSession
    urls = pages.select(pages[id_col].alias(id_col), url_host(pages[url_col]).alias("host"), url_path(pages[url_col]).alias("path"))
    different = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    probes = different.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: _key(F.slice(labels, i, F.size(labels)), F.col("path")))).alias("key")).select(
        F.col("key").cast("binary").alias("key"), F.lit(1).alias("kind"), F.xxhash64("host", "path").alias("salt"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")
    )
    known = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    opened = known.select(
        _key(labels, F.col("path")).cast("binary").alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("salt"), "host", "path", F.concat("host", "path").alias("rule"), "verdict"
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # the lowest hashes of different keys: the same keys on every run, and at most SAMPLE rows
    sample = probes.select(F.substring("key", 1, SAMPLE_CHARS).alias("key"), "salt").orderBy(F.xxhash64("key", "salt"), "key", "salt").limit(SAMPLE).collect()
    order = sorted((bytes(r.key), r.salt) for r in sample)
    limits = sorted({order[len(order) * i // parts] for i in range(1, parts)}) if order else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds, salts = (column(batch, n).to_pylist() for n in ("key", "kind", "salt"))
            rows, dealt = [], []
            for row, (key, kind, salt) in enumerate(zip(keys, kinds, salts, strict=True)):
                if kind:
                    first = last = bisect_right(limits, (key, salt))
                else:
                    first, last = bisect_right(limits, (key, -(2**63))), bisect_right(limits, (key + b"\xff", 2**63))
                rows.extend([row] * (last - first + 1))
                dealt.extend(range(first, last + 1))
            taken = batch.select(["key", "kind", "host", "path", "rule", "verdict"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(dealt, pa.int32()), *taken.columns], names=["part", *taken.schema.names])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []
        for batch in batches:
            rows, rules_, verdicts = [], [], []
            for row, (p, key, kind, rule, verdict) in enumerate(zip(*(column(batch, n).to_pylist() for n in ("part", "key", "kind", "rule", "verdict")), strict=True)):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not kind:
                    stack.append((key, rule, verdict))
                elif stack:
                    rows.append(row)
                    rules_.append(stack[-1][1])
                    verdicts.append(stack[-1][2])
            taken = batch.select(["host", "path"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(rules_, pa.string()), pa.array(verdicts, pa.string())], names=["host", "path", "rule", "verdict"])

    dealt = probes.union(opened).mapInArrow(deal, _FIELDS).repartition(parts, "part").sortWithinPartitions("part", "key", "kind")
    found = dealt.mapInArrow(sweep, "host string, path string, rule string, verdict string")
    rank = F.struct(F.length("rule").alias("length"), F.length(F.regexp_extract("rule", "^[^/]*", 0)).alias("host_length"))
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
