"""Declared constraints as audits: checks, unique keys, foreign keys, required names, cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarch.functions.text import trim_ws
from scholarch.schemas import CHECKS, FOREIGN_KEYS, UNIQUE_KEYS
from scholarch.session import materialize


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def audit_checks(tables: dict[str, DataFrame], checks: dict[str, dict[str, str]] = CHECKS) -> DataFrame:
    """(table, rule, row_key): one row per violated check; one pass per table."""
    parts = []
    for table, rules in checks.items():
        df = tables[table]
        usable = {r: p for r, p in rules.items() if r == "dates" or r in df.columns}
        hit = F.filter(F.array(*[F.when(F.expr(p), F.lit(r)) for r, p in usable.items()]), lambda x: x.isNotNull())
        key = [c for c in ("id", "inscriptionPer_id", "etudiant_id") if c in df.columns][0]
        # the outer form keeps the array computed once; the null test drops rows without a hit
        found = df.select(F.lit(table).alias("table"), F.col(key).cast("long").alias("row_key"), F.explode_outer(hit).alias("rule"))
        parts.append(found.filter("rule is not null"))
    return _union(parts)


def audit_unique(tables: dict[str, DataFrame], keys: list[tuple[str, tuple[str, ...]]] = UNIQUE_KEYS) -> DataFrame:
    """(table, key, value, n): business keys held by more than one row (partial aggregates)."""
    parts = []
    for table, cols in keys:
        value = F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("value")
        counted = tables[table].groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")
        parts.append(counted.select(F.lit(table).alias("table"), F.lit(",".join(cols)).alias("key"), value, "n"))
    return _union(parts)


def _id_bits(df: DataFrame, columns: list[tuple[int, str]], side: str) -> DataFrame:
    """(k, block, side): the whole numbers of the numbered columns, each as one bit of its block of 64 neighbours."""
    ids = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("long").alias("id")) for k, c in columns]))
    bit = F.expr("shiftleft(1L, CAST(x.id & 63 AS INT))").alias(side)
    return df.select(ids.alias("x")).filter("x.id IS NOT NULL").select("x.k", F.shiftright("x.id", 6).alias("block"), bit)


def audit_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, column, value, n): non-null references without a parent.

    References and parents meet as blocks of 64 neighbouring ids (one aggregate for all keys), so that
    neither side is sorted or held id by id; ids far apart take a row each, as they would anyway.
    Only the references found lost are counted, from a second look at the columns that have any.
    """
    referring: dict[str, list] = {}
    referred: dict[str, list] = {}
    for k, (child, column, parent, _) in enumerate(FOREIGN_KEYS):
        referring.setdefault(child, []).append((k, column))
        referred.setdefault(parent, []).append((k, "id"))
    refs = _union([_id_bits(tables[t], columns, "refs") for t, columns in referring.items()])
    ids = _union([_id_bits(tables[t], columns, "ids") for t, columns in referred.items()])
    met = refs.unionByName(ids, allowMissingColumns=True).groupBy("k", "block").agg(F.bit_or("refs").alias("refs"), F.bit_or("ids").alias("ids"))
    bits = F.col("refs").bitwiseAND(F.bitwise_not(F.coalesce("ids", F.lit(0).cast("long"))))
    lost = materialize(met.select("k", "block", bits.alias("bits")).filter("bits <> 0"), "lost-references")
    found = []
    for k in sorted(r["k"] for r in lost.select("k").distinct().collect()):  # one row a foreign key at most
        child, column, _, _ = FOREIGN_KEYS[k]
        refs = tables[child].select(F.col(column).cast("long").alias("value")).withColumn("block", F.shiftright("value", 6))
        hit = refs.join(lost.where(F.col("k") == k).select("block", "bits"), "block").filter("shiftright(bits, CAST(value & 63 AS INT)) & 1 = 1")
        counted = hit.groupBy("value").agg(F.count("*").alias("n"))
        found.append(counted.select(F.lit(child).alias("child"), F.lit(column).alias("column"), "value", "n"))
    if not found:
        return lost.select(F.lit("").alias("child"), F.lit("").alias("column"), F.col("block").alias("value"), F.col("bits").alias("n"))
    return _union(found)


def cascade_delete(tables: dict[str, DataFrame], table: str, doomed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete the ids in `doomed` from `table`: (tables afterwards, refused ids).

    Each id is one delete: all rows that CASCADE reaches from it go with it, SET NULL children
    lose the reference, and if any row outside that closure refers to a row inside it by
    RESTRICT, the whole delete of that id is refused and nothing of it changes.  The closure is
    collected first, over the foreign keys among the tables given, which have no circles.
    """
    keys = [k for k in FOREIGN_KEYS if k[0] in tables and k[2] in tables]
    closure = {table: doomed.select(F.col("id").alias("root"), "id").distinct()}
    reached = [table]
    for parent in reached:  # grows while it is read
        for child, column, _, rule in (k for k in keys if k[2] == parent and k[3] == "CASCADE" and "id" in tables[k[0]].columns):
            rows = tables[child].select("id", F.col(column).alias("_p")).join(closure[parent].select("root", F.col("id").alias("_p")), "_p").select("root", "id")
            closure[child] = rows if child not in closure else closure[child].union(rows).distinct()
            if child not in reached:
                reached.append(child)

    refused = None
    for child, column, parent, rule in keys:
        if rule != "RESTRICT" or parent not in closure:
            continue
        held = tables[child].filter(F.col(column).isNotNull())
        has_id = child in closure
        rows = held.select(F.col(column).alias("_p"), *(["id"] if has_id else []))
        if not has_id:
            rows = rows.distinct()  # many references to one row are one
        touching = rows.join(closure[parent].select("root", F.col("id").alias("_p")), "_p")
        if has_id:
            touching = touching.join(closure[child], ["root", "id"], "left_anti")
        roots = touching.select("root").distinct()
        refused = roots if refused is None else refused.union(roots)
    blocked = doomed.select(F.col("id").alias("root")).limit(0) if refused is None else refused.distinct()

    out = dict(tables)
    gone = {name: rows.join(blocked, "root", "left_anti").select("id").distinct() for name, rows in closure.items()}
    for name, ids in gone.items():
        out[name] = out[name].join(ids, "id", "left_anti")
    for child, column, parent, rule in keys:
        if parent not in gone or rule == "RESTRICT":
            continue
        lost = gone[parent].select(F.col("id").alias(column))
        if rule == "CASCADE" and child not in closure:
            out[child] = out[child].join(lost, column, "left_anti")
        elif rule == "SET NULL":
            marked = out[child].join(lost.withColumn("_gone", F.lit(True)), column, "left")
            out[child] = marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*out[child].columns)
    return out, blocked.select(F.col("root").alias("id"))


def validate_required_names(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, failed): both names non-blank, else a failure row with its index."""
    blank = (trim_ws(F.coalesce("nom", F.lit(""))) == "") | (trim_ws(F.coalesce("prenom", F.lit(""))) == "")
    failed = rows.filter(blank).select("index", F.lit("failed").alias("status"), F.lit("nom and prenom are required").alias("error"))
    return rows.filter(~blank), failed
