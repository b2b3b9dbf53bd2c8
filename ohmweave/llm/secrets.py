"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed: its blob is the SHA-256 of its text. The ledger is a stored table
that holds, for each blob and rule version that has been scanned, the spans found (possibly none). A run scans only
those blob and rule-version pairs that the ledger lacks, once for each blob however many paths and versions
share it, appends them, and joins the ledger's findings back to all paths. Texts are read where they lie: only
hashes, ids and findings are shuffled.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, forget, join_split, made_of, shared_dir, stored


@dataclass(frozen=True)
class Rule:
    """One kind of secret. Matches run leftmost and non-overlapping; those for which `holds` is false are dropped."""

    kind: str
    version: int
    pattern: str
    hint: str  # a cheaper pattern that every text with a match matches
    group: int = 0  # the group whose length counts
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


# The base patterns.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", 1, ASSIGN, ASSIGN, 2, 6),
    # a run of over 20 characters from AKIA on is the whole greedy match, and a shorter one fails with all its suffixes
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", "AKIA"),
    # likewise: the maximal runs of [0-9a-f]+ that have 24 or more characters
    Rule("hex", 1, r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
)
EXTRA = (
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", "eyJ"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN "),
    Rule("provider", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", r"gh[pousr]_|xox[abprs]-|sk_live_"),
)
SPANS = "array<struct<start:int,end:int>>"
STEPS = "array<struct<gap:int,len:int,key:int>>"
LEDGER = f"blob string, rule string, spans {SPANS}"


def blob_of(text_col: str) -> Column:
    return F.sha2(text_of(text_col).cast("binary"), 256)


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def steps(text: Column, rule: Rule) -> Column:
    """For each match of the rule: code points between it and the one before, its own, those of the group that counts.

    The text between matches and the matches alternate; running sums of these give positions (see placed).
    """
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    key = lambda x: F.length(F.regexp_extract(x, rule.pattern, rule.group) if rule.group else x)
    found = F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda gap, x: F.struct(F.length(gap).alias("gap"), F.length(x).alias("len"), key(x).alias("key")))
    hit = F.contains(text, F.lit(rule.hint)) if rule.hint.replace("-", "").replace(" ", "").isalnum() else text.rlike(rule.hint)
    return F.when(hit, found).otherwise(F.expr(f"cast(array() as {STEPS})"))


def placed(raw: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, spans) of (blob, rule, steps): running sums over each pair's matches, then those that hold."""
    at = Window.partitionBy("blob", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = raw.where(F.size("steps") > 0).select("blob", "rule", F.posexplode("steps").alias("nth", "s"))
    end = F.sum(F.col("s.gap") + F.col("s.len")).over(at).cast("int")
    each = each.select("blob", "rule", "s", end.alias("end"))
    least = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.least))])
    span = F.when(F.col("s.key") >= least[F.col("rule")], F.struct((F.col("end") - F.col("s.len")).alias("start"), "end"))
    found = each.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(span)).cast(SPANS).alias("spans"))
    return found.unionByName(raw.where(F.size("steps") == 0).select("blob", "rule", F.expr(f"cast(array() as {SPANS})").alias("spans")))


def scan(versions: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, ledger: DataFrame | None = None, text_col: str = "text", id_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new, state): what to append to the ledger, and the ledger after it for the blobs at hand; columns LEDGER.

    versions: any rows with a text; null counts as empty. Of rows with equal texts one is scanned: the one of the
    least id (id_col), so that no text moves, or any one after a shuffle if there are no ids.
    """
    named = versions.select(blob_of(text_col).alias("blob"), text_of(text_col).alias("text"), (F.col(id_col) if id_col else F.lit(None)).alias("id"))
    at_hand = stored(named.groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keep")), "blobs")
    have, total = {}, at_hand.count()
    if ledger is not None:
        wanted = ledger.where(F.col("rule").isin([r.key for r in rules])).join(at_hand.select("blob"), "blob", "left_semi").select("blob", "rule", "spans")
        have = dict(wanted.groupBy("rule").agg(F.countDistinct("blob")).collect())  # a row for each rule
    due = [r for r in rules if have.get(r.key, 0) < total]
    if not due:
        new = made_of(versions.sparkSession.createDataFrame([], LEDGER), at_hand)
        return new, new if ledger is None else wanted
    if id_col:
        repeated = broadcast_if_small(at_hand.where("n > 1").select("blob", "keep", F.lit(True).alias("again")), 400_000, F.lit(80))
        once = named.join(repeated, "blob", "left").where("again is null or id <=> keep").select("blob", "text")
    else:
        once = named.select("blob", "text").dropDuplicates(["blob"])
    seen = F.expr("cast(array() as array<string>)")
    partly = [r.key for r in due if have.get(r.key, 0)]
    if partly:  # rules that all or none of the blobs have met need no look-up
        told = wanted.where(F.col("rule").isin(partly)).groupBy("blob").agg(F.collect_set("rule").alias("told"))
        once = once.join(broadcast_if_small(told, size=F.lit(80) + 16 * F.size("told")), "blob", "left")
        seen = F.coalesce("told", seen)
        once = once.where(F.size(seen) < len(due))
    found = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.when(~F.array_contains(seen, r.key), steps(F.col("text"), r)).alias("steps")) for r in due])
    raw = once.select("blob", found.alias("found")).dropDuplicates(["blob"])  # rows of one id and text were both scanned
    raw = stored(raw.select("blob", F.inline("found")).where(F.col("steps").isNotNull()), "matches")
    new = stored(placed(raw, tuple(due)), "scanned")
    new = made_of(new, new, at_hand)  # the state reads both
    forget(raw)
    return new, new if ledger is None else wanted.unionByName(new)


class Ledger:
    """A stored ledger: a Parquet table in a folder of its own below the shared one, or at `at`, which later runs may name."""

    def __init__(self, spark: SparkSession, at: str | None = None):
        self.spark, self.at = spark, at or f"{shared_dir(spark)}/ohmweave-ledger-{uuid.uuid4().hex}"

    def read(self) -> DataFrame:
        """All that has been scanned (LEDGER); empty before the first update."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at)
        there = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        return self.spark.read.schema(LEDGER).parquet(self.at) if there else self.spark.createDataFrame([], LEDGER)

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, text_col: str = "text", id_col: str | None = None) -> DataFrame:
        """Scan what the ledger lacks of versions x rules and append it; returns what was appended."""
        new, _ = scan(versions, rules, self.read(), text_col, id_col)
        new.write.mode("append").parquet(self.at)
        return new


def joined(spans_col: Column) -> Column:
    """kind:start:end by start, then by the kinds' order, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(spans_col), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = EXTRA, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs.

    rules are added to the base ones. A null text counts as empty; a text without a secret has zeros, the
    SHA-256 of the empty string and empty spans. Repeated rows get a row each, null ids too. An empty table
    gives an empty result. Spans that begin together go by the rules' order. Other columns of docs are not looked at.
    """
    every = BASE + tuple(rules)
    _, state = scan(docs, every, ledger, text_col, id_col)
    return reported(docs, state, every, id_col, text_col)


def find_secrets_by_ledger(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = EXTRA, earlier: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_secrets over a stored ledger, which is brought up to date twice: with the base rules over `earlier`, the rows
    that were there first (all of docs, if not given), then with all rules over docs. The second update scans for the base
    rules only in blobs that the ledger lacks, for the added rules in all."""
    every = BASE + tuple(rules)
    forget(ledger.update(docs if earlier is None else earlier, BASE, text_col, id_col))
    forget(ledger.update(docs, every, text_col, id_col))
    return reported(docs, ledger.read(), every, id_col, text_col)


def reported(docs: DataFrame, state: DataFrame, every: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """The ledger's findings joined back to every row of docs; a pair that two writers appended at once counts once."""
    hits = state.where((F.size("spans") > 0) & F.col("rule").isin([r.key for r in every])).dropDuplicates(["blob", "rule"]).withColumn("kind", F.substring_index("rule", ":", 1))
    order = F.create_map(*[x for i, r in enumerate(every) for x in (F.lit(r.kind), F.lit(i))])
    rows = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("kind")].alias("order"), F.col("kind").alias("kind"), s["end"].alias("end"))).alias("all"))
    per_blob = rows.groupBy("blob").agg(F.flatten(F.collect_list("all")).alias("all"))  # a row for each rule at most
    base = F.filter("all", lambda x: x["order"] < len(BASE))
    count = lambda kind: F.size(F.filter("all", lambda x: x["kind"] == kind)).cast("long")
    digest = per_blob.select("blob", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
    paths = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), blob_of(text_col).alias("blob")), "paths")
    out = join_split(paths, stored(digest, "findings"), "blob", "left")
    return out.select("doc_id", *(F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in BASE), F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def drop_secrets(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a secret of any rule. Rows with a null id go by their text alone."""
    _, state = scan(docs, BASE + EXTRA, ledger, text_col, id_col)
    bad = broadcast_if_small(state.where(F.size("spans") > 0).select("blob").distinct(), size=F.lit(80))
    rows = docs.select(F.struct("*").alias("row"), blob_of(text_col).alias("blob"))
    return rows.join(bad, "blob", "left_anti").select("row.*")


#: The rows of find_secrets with the base rules alone have no other spans; DuckDB has no match positions, so
#: the pieces between matches are measured, as above.
def oracle_sql(kinds: tuple[Rule, ...] = BASE + EXTRA) -> str:
    import re

    parts = []
    for i, r in enumerate(kinds):
        p = re.sub(r"\\x20", " ", r.pattern).replace("'", "''")
        parts.append(f"""select doc_id, '{r.kind}' kind, {i} ord, regexp_extract_all(t, '{p}', 0) w, regexp_extract_all(t, '{p}', {r.group}) g, string_split_regex(t, '{p}') b, {r.least} least from d""")
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
m as ({" union all ".join(parts)}),
x as (select doc_id, kind, ord, least, unnest(range(1, len(w) + 1)) i, w, g, b from m where len(w) > 0),
s as (select doc_id, kind, ord, list_sum(list_transform(b[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda y: length(y))), 0) st, length(w[i]) n from x where length(g[i]) >= least),
a as (select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
  coalesce(string_agg(kind || ':' || st::bigint || ':' || (st + n)::bigint, ',' order by st, ord) filter (ord < {len(BASE)}), '') base,
  string_agg(kind || ':' || st::bigint || ':' || (st + n)::bigint, ',' order by st, ord) spans from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join a using (doc_id)"""
