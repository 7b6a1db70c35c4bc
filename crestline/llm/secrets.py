"""Secret scan with corpus-wide ownership frequency; DataFrame functions only.

Base findings are pattern matches of three kinds. Beside them stand candidates: long tokens that look like credentials
(letters and digits, many different characters). The hashes of all values are counted by distinct owner and repository
over the whole corpus. A value under many owners is a copied example; a live-looking one under a single owner is its
own credential. Added spans, where they touch no base span: `known`, a bare token whose value a base pattern found
somewhere in the corpus, and `owned`, a candidate that a single owner has.

Distribution. Texts are scanned once and never shuffled: what goes on are the matches of rows that have any. Counts are
aggregated by (hash, owner, repository), then (hash, owner), then hash, so a value that a third of the corpus holds is
reduced before each shuffle; the join back has one row a hash on one side, so a hot hash's other side can be split.

Edge cases: a null or empty text has no findings; a null owner or repository counts as one of its own, ''; repeated
rows and ids give a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

# The base patterns, with the group that holds the value and its least length.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
CANDIDATE = r"[A-Za-z0-9_+=-]{20,}"
BASE = tuple(PATTERNS)
KINDS = (*BASE, "known", "owned")
DISTINCT_CHARACTERS = 10
VERDICTS = ("copied", "owned", "shared")


def matches(text: Column, pattern: str, group: int) -> Column:
    """Array of (gap, size, value) in order: characters before the match since the last one, its length, its value.

    The text is cut at the matches; null where there is none, after one search that stops at the first.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.zip_with(F.arrays_zip(whole.alias("m"), values.alias("v")), F.slice(gaps, 1, F.size(whole)), lambda x, g: F.struct(g.alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("value")))
    return F.when(text.rlike(pattern), found)


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: tuple[str, ...], carry: bool = False) -> DataFrame:
    """One written row per document: row, key, owner, repo, an array of matches per kind (null if none) and, to carry on, the document itself as `doc`."""
    text = text_or_empty(text_col)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = [matches(text, p, g).alias(k) for k, (p, g, _) in PATTERNS.items()]
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if carry else []
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("key"), F.xxhash64(text).alias("text_hash"), named(owner_col).alias("owner"), F.to_json(F.array(*(named(c) for c in repo_cols))).alias("repo"), *found, matches(text, CANDIDATE, 0).alias("candidate"), *whole))


def placed(scanned: DataFrame) -> DataFrame:
    """A row per match that holds: row, owner, repo, kind, start, end, value. Places are running sums in a text."""
    each = None
    for kind in (*BASE, "candidate"):
        own = scanned.where(F.col(kind).isNotNull()).select("row", "owner", "repo", F.lit(kind).alias("kind"), F.posexplode(kind).alias("pos", "m"))
        each = own if each is None else each.unionAll(own)
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto)).withColumn("value", F.col("m.value"))
    fits = F.lit(False)
    for kind, (_, group, least) in PATTERNS.items():
        fits = fits | ((F.col("kind") == kind) & (F.length("value") >= least))
    looks = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split("value", ""))) >= DISTINCT_CHARACTERS)
    each = each.where(fits | ((F.col("kind") == "candidate") & looks))
    return each.select("row", "owner", "repo", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end", F.sha2(F.col("value").cast("binary"), 256).alias("hash"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repos, hits and whether a base pattern found it anywhere."""
    base = F.max(F.col("kind") != "candidate").alias("base")
    a = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("hits"), base)
    b = a.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("hits").alias("hits"), F.max("base").alias("base"))
    return b.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("hits").alias("hits"), F.max("base").alias("base"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), copied: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows, findings). rows: row, id and text_hash of every document. findings: row, kind, start, end, hash, owners, repos and
    verdict: 'copied' (at least `copied` owners), 'owned' (one) or 'shared'."""
    scanned = scan(docs, id_col, text_col, owner_col, repo_cols)
    return scanned.select("row", F.col("key").alias(id_col), "text_hash"), judged(scanned, copied)


def judged(scanned: DataFrame, copied: int) -> DataFrame:
    """The findings of scanned rows, as find() gives them."""
    found = cut(placed(scanned))
    counts = ownership(found)
    verdict = F.when(F.col("owners") >= copied, "copied").when(F.col("owners") == 1, "owned").otherwise("shared")
    every = found.join(counts, "hash").withColumn("verdict", verdict)
    known = (F.col("kind") == "candidate") & F.col("base")
    owned = (F.col("kind") == "candidate") & ~F.col("base") & (F.col("owners") == 1)
    every = every.withColumn("kind", F.when(known, "known").when(owned, "owned").otherwise(F.col("kind"))).where("kind <> 'candidate'")
    # A candidate counts only clear of base spans: of those that start before its end, the furthest end is checked.
    order = Window.partitionBy("row").orderBy("at", "last").rowsBetween(Window.unboundedPreceding, 0)
    is_base = F.col("kind").isin(*BASE)
    ends = every.withColumn("at", F.when(is_base, F.col("start")).otherwise(F.col("end") - 1)).withColumn("last", (~is_base).cast("int"))
    clear = ends.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(order))
    return clear.where(is_base | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).select("row", "kind", "start", "end", "hash", "owners", "repos", "verdict")


def listing(keep: Column | None = None) -> Column:
    """kind:start:end of the findings of a group, by start and then kind, joined with commas."""
    order = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i))), F.col("kind"))
    entry = F.struct("start", order.alias("order"), F.concat_ws(":", "kind", "start", "end").alias("said"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(entry if keep is None else F.when(keep, entry))), lambda x: x["said"]), ",")


def digests(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Per document the counts of base kinds, a digest of the base spans, and all spans."""
    base = F.col("kind").isin(*BASE)
    own = findings.groupBy("row").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE), listing(base).alias("base"), listing().alias("spans"))
    out = rows.join(own, "row", "left")
    return out.select(
        *[c for c in rows.columns if c not in ("row", "text_hash")],
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(*find(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), mask: str = "[SECRET]", length_col: str = "n_chars", verdicts: tuple[str, ...] = VERDICTS, copied: int = 3) -> DataFrame:
    """The documents with every found span of these verdicts replaced (overlapping spans by one mask); length_col, if present, is set anew.

    The scan writes the documents along with their matches, so a text without a match goes straight to the result, and
    only rows with one meet their spans by shuffle.
    """
    scanned = scan(docs, id_col, text_col, owner_col, repo_cols, carry=True)
    hit = F.coalesce(*(F.col(k) for k in PATTERNS), F.col("candidate")).isNotNull()
    findings = judged(scanned, copied).where(F.col("verdict").isin(*verdicts))
    spans = findings.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # Spans that touch become one: a span starts a new one if it begins at or after the furthest end so far.
    whole = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] < F.try_element_at(acc, F.lit(-1))["end"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    text = F.col(f"doc.`{text_col}`")
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("merged", lambda x: x["end"]))
    starts = F.concat(F.transform("merged", lambda x: x["start"]), F.array(F.length(text).cast("bigint")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")))
    found = scanned.where(hit).select("row", "doc").join(spans, "row", "left").withColumn("merged", whole)
    found = found.withColumn("clean", F.when(F.col("merged").isNotNull(), F.array_join(pieces, mask)).otherwise(text))
    columns = []
    for c in docs.columns:
        own = F.col(f"doc.`{c}`")
        if c == text_col:
            own = F.col("clean")
        elif c == length_col:
            own = F.when(F.col("merged").isNotNull(), F.length("clean").cast(docs.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    return scanned.where(~hit).select("doc.*").unionAll(found.select(*columns))


def _sql() -> str:
    """The same in DuckDB: cut each text at the matches, sum the pieces, count owners, keep what is clear of base spans."""
    kinds = {**PATTERNS, "candidate": (CANDIDATE, 0, 20)}
    quoted = {k: p.replace("'", "''") for k, (p, _, _) in kinds.items()}
    each = " UNION ALL ".join(
        f"SELECT doc_id, owner, repo, '{k}' AS kind, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS m, unnest(v) AS value, unnest(list_transform(g[1:len(w)], lambda x: length(x))) AS gap, {least} AS least FROM "
        f"(SELECT doc_id, owner, repo, regexp_extract_all(t, '{quoted[k]}', 0) AS w, regexp_extract_all(t, '{quoted[k]}', {group}) AS v, string_split_regex(t, '{quoted[k]}') AS g FROM d) WHERE len(w) > 0"
        for k, (_, group, least) in kinds.items()
    )
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || '|' || coalesce(lang, '') AS repo FROM documents),
e AS ({each}),
p AS (SELECT *, sum(gap + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS stop FROM e),
f AS (SELECT doc_id, owner, kind, stop - length(m) AS start, stop, value FROM p
      WHERE length(value) >= least AND (kind <> 'candidate' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
            AND len(list_distinct(string_split(value, ''))) >= {DISTINCT_CHARACTERS}))),
c AS (SELECT value, count(DISTINCT owner) AS owners, bool_or(kind <> 'candidate') AS base FROM f GROUP BY value),
j AS (SELECT doc_id, start, stop, CASE WHEN kind <> 'candidate' THEN kind WHEN base THEN 'known' WHEN owners = 1 THEN 'owned' END AS kind FROM f JOIN c USING (value)),
s AS (SELECT *, CASE kind {order} END AS o FROM j WHERE kind IS NOT NULL AND (kind IN ({base}) OR NOT EXISTS
      (SELECT 1 FROM j b WHERE b.doc_id = j.doc_id AND b.kind IN ({base}) AND b.start < j.stop AND j.start < b.stop))),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, o) FILTER (kind IN ({base})) AS base,
      string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, o) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
