"""Secret scans over an incremental blob ledger.

Every version of every file is addressed by the SHA-256 of its content.  A
ledger holds what each rule version found in each blob; a run scans only the
pairs of blob and rule version that the ledger lacks, adds them, and joins
the findings back to all paths and versions that have the blob.  Only
DataFrame functions are used.

A rule finds leftmost non-overlapping matches of its pattern and drops those
that are too short.  Spans are code points, end exclusive.

Defined cases: a null text is empty and has no findings; equal texts are one
blob, scanned once, with findings on every row; a null path is a path; an
empty table gives an empty result.

Scale: hashes are compared with the ledger first, so an incremental run moves
the texts of unseen blobs only; a blob's copies are reduced map-side before
they move, and each blob is scanned in the task that holds its one copy.
Spans are added up in blocks of ``BLOCK`` matches, so a text that is all
matches takes little more time than its length.  The join back to paths moves
hashes and ids only, and only blobs with findings are on its other side;
Spark splits a blob that has very many paths (skew join).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptsearch.llm.tables import fresh, materialise


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: str = "1"

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of hex digits is one match whether shorter ones match or not
)

BASE = tuple(r.kind for r in RULES)
# Rules of this library's own, listed after the base rules.
RULES += (
    Rule("key", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("provider", r"(?:ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|npm_|AIza)[A-Za-z0-9_-]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,1000}\.eyJ[A-Za-z0-9_-]{10,1000}\.[A-Za-z0-9_-]+", 0, 40),
    Rule("url", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,200}:[^\x20\x09-\x0D/:@]{1,200}@", 0, 1),
)
#: Matches whose spans are added up in one go.
BLOCK = 256
#: Unseen hashes (65 bytes each) up to which they are broadcast.
MAX_BROADCAST_BLOBS = 500_000

SPANS = "array<struct<start:bigint,kind:string,end:bigint>>"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda, an
    expression of the row would be computed again for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def _laid_out(sized: Column, rule: Rule) -> Column:
    """Spans of matches given as (gap, size, test): running sums in blocks,
    then the blocks moved to their places."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + m["size"]
        span = F.array(F.struct(begin.alias("start"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"),
                        F.when(m["test"] >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))

    number = F.sequence(F.lit(0), F.floor((F.size(sized) - 1) / BLOCK).cast("int"))
    blocks = F.transform(number, lambda b: F.aggregate(F.slice(sized, b * BLOCK + 1, BLOCK), start, step))
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPANS}>").alias("spans"))
    whole = F.aggregate(blocks, none, lambda acc, x: F.struct(
        (acc["at"] + x["at"]).alias("at"), F.concat(acc["spans"], F.array(moved(x["spans"], acc["at"]))).alias("spans")))
    return F.flatten(whole["spans"])


def find(text: Column, rule: Rule) -> Column:
    """The spans of a rule in a text: matches lie between the pieces that
    splitting at them leaves, so lengths give their places."""
    pattern = F.lit(rule.pattern)
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)

    def sized(found: Column) -> Column:
        pairs = F.zip_with(found, tested if rule.group else found,
                           lambda m, g: F.struct(F.length(m).alias("size"), F.length(g).alias("test")))
        return F.zip_with(pairs, F.slice(gaps, 1, F.size(found)),
                          lambda m, gap: F.struct(gap.alias("gap"), m["size"].alias("size"), m["test"].alias("test")))

    matches = _once(F.regexp_extract_all(text, pattern, F.lit(0)), sized)
    return F.when(text.rlike(rule.pattern), _once(matches, lambda m: _laid_out(m, rule))).otherwise(F.array().cast(SPANS))


def scan(history: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
         text: str = "text") -> DataFrame:
    """New ledger rows (blob, rule, spans) for the blobs of ``history`` and
    the rule versions that ``ledger`` has no row for."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = history.select(F.sha2(content, 256).alias("blob"), content.alias("text"))
    wanted = F.array(*(F.lit(r.key) for r in rules))
    if ledger is None:
        todo = rows.withColumn("todo", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # as many as there are rule versions
        unseen = (rows.select("blob").distinct().join(seen, "blob", "left")
                  .select("blob", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
                  .filter(F.size("todo") > 0))
        unseen = materialise(unseen, "unseen")
        few = unseen.limit(MAX_BROADCAST_BLOBS + 1).count() <= MAX_BROADCAST_BLOBS
        todo = rows.join(F.broadcast(unseen) if few else unseen, "blob")
    blobs = todo.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    results = F.array(*(F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.key).alias("rule"),
                                                                        find(F.col("text"), r).alias("spans")))
                        for r in rules))
    return (blobs.select("blob", F.explode(results).alias("x")).filter("x is not null")
            .select("blob", "x.rule", "x.spans"))


def findings(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES,
             text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Every row of ``history`` with blob and spans, by start, then in the
    order of the rules; and the names these columns got."""
    names = dict(zip(("blob", "spans"), fresh(history, "blob", "spans"), strict=True))
    order = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)))
    hits = (ledger.filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
            .groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("found")))  # one list a rule
    ranked = F.array_sort(F.transform("found", lambda s: F.struct(s["start"], order[s["kind"]].alias("k"), s["kind"], s["end"])))
    hits = hits.select(F.col("blob").alias("of"), F.transform(ranked, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("found"))
    blob, found, of = fresh(history, "blob_", "found", "of")
    hits = hits.toDF(of, found)
    out = history.withColumn(blob, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    out = out.join(hits, F.col(blob) == F.col(of), "left")
    columns = [F.col(f"`{c}`") for c in history.columns]
    return out.select(*columns, F.col(blob).alias(names["blob"]),
                      F.coalesce(F.col(found), F.array().cast(SPANS)).alias(names["spans"])), names


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row,
    through a ledger that starts empty."""
    docs = docs.select("doc_id", "text")
    ledger = materialise(scan(docs), "ledger")
    out, _ = findings(docs, ledger)
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = joined(F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return out.select("doc_id", *map(count, BASE), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
