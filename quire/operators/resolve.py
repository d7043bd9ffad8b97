"""Keyword -> seed URL resolution (J1-J4) and reverse doc_type lookup.

Tiers, each used only when the earlier ones miss:
  0 empty request      -> error "keyword_or_url cannot be empty"
  1 http(s) URL        -> passthrough
  2 exact keyword      -> its url
  3 case-insensitive   -> url of the first such entry in registry order
  4 substring (lower)  -> one hit: its url; several: "matches multiple APIs";
                          none: "not found ... Available keywords"

Substring matching is a theta join.  It is run as an *equi* join on a
character gram: a string contains a needle only if it contains one fixed
piece of the needle (its *probe*: the needle itself when shorter than
``GRAM`` characters, else the ``GRAM`` characters right after '://' when
present, else its first ``GRAM`` characters).  The haystack side is exploded
into its distinct substrings of length 1..GRAM, joined on the probe, and the
real ``instr`` predicate is applied.  Exact for any registry size, no cross
join, no broadcast of an unbounded side; the probe skips the shared
'https://' prefix so URLs do not all land on one key, and AQE splits a hot
gram.  Exact and case-insensitive hits are substring hits too, so all four
keyword tiers come out of this one join and one aggregation per request.

Message lists (ambiguous matches, available keywords) name every keyword, in
registry order.  Where such a list is unwieldy, :func:`keyword_matches` has
the matches as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import urls as U
from quire.operators.common import sized

GRAM = 8


def _key_grams(col: F.Column, lengths=range(1, GRAM + 1)) -> F.Column:
    """Distinct substrings of ``col`` with the given lengths (default 1..GRAM)."""
    n = F.length(col)

    # one-argument lambdas only: a second parameter would be bound to the index
    def take(k: int):
        return lambda i: F.substring(col, i, F.lit(k))

    def full(k: int):
        return lambda g: F.length(g) == F.lit(k)

    grams = [F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), take(k)), full(k))
             for k in lengths]
    return F.array_distinct(F.concat(*grams))


def _probe_lengths(df: DataFrame, col: str) -> list[int]:
    """Distinct probe lengths (<= GRAM values, a bounded driver-side set):
    the other side only needs its substrings of these lengths."""
    rows = df.select(F.least(F.length(col), F.lit(GRAM)).alias("k")).where(F.col("k") > 0).distinct().collect()
    return sorted(int(r["k"]) for r in rows) or [GRAM]


def _probe(col: F.Column) -> F.Column:
    """A fixed GRAM-long piece of ``col`` (all of it when shorter)."""
    n = F.length(col)
    after = F.instr(col, "://") + 3
    start = F.when((F.instr(col, "://") > 0) & (after + GRAM - 1 <= n), after).otherwise(F.lit(1))
    return F.when(n <= GRAM, col).otherwise(F.substring(col, start, F.lit(GRAM)))


def _names(entries: DataFrame, *key: str) -> DataFrame:
    """Per ``key`` (or over all): the keywords by pos, comma-separated."""
    by_pos = F.array_sort(F.collect_list(F.struct("pos", "keyword")))
    return entries.groupBy(*key).agg(F.array_join(F.transform(by_pos, lambda s: s["keyword"]), ", ").alias("names"))


def _hits(req: DataFrame, registry: DataFrame) -> DataFrame:
    """Keyword requests with each registry entry whose keyword contains them."""
    reg = registry.select("pos", "keyword", "url", F.lower("keyword").alias("key_l"))
    kw = req.where((F.col("keyword_or_url") != "") & ~U.is_url("keyword_or_url"))
    reg_grams = reg.select("pos", "keyword", "url", "key_l",
                           F.explode(_key_grams(F.col("key_l"), _probe_lengths(kw, "kw_l"))).alias("g"))
    probes = kw.select("req_id", "keyword_or_url", "kw_l", _probe(F.col("kw_l")).alias("g"))
    return (probes.join(reg_grams, "g").where(F.instr("key_l", F.col("kw_l")) > 0)
            .select("req_id", "keyword_or_url", "kw_l", "pos", "keyword", "url", "key_l"))


def keyword_matches(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """A11 as rows: (req_id, pos, keyword) of every registry keyword that contains the request."""
    req = requests.select("req_id", "keyword_or_url", F.lower("keyword_or_url").alias("kw_l"))
    return _hits(req, registry).select("req_id", "pos", "keyword")


def resolve_keywords(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """requests(req_id, keyword_or_url) x registry(pos, keyword, url) ->
    (req_id, keyword_or_url, tier, url, error)."""
    req = requests.select("req_id", "keyword_or_url", F.lower("keyword_or_url").alias("kw_l"))
    hits = _hits(req, registry)
    per_req = hits.groupBy("req_id").agg(
        F.max(F.when(F.col("keyword") == F.col("keyword_or_url"), F.col("url"))).alias("exact_url"),
        F.min(F.when(F.col("key_l") == F.col("kw_l"), F.struct("pos", "url"))).alias("ci"),
        F.count(F.lit(1)).alias("n_sub"),
        F.min(F.struct("pos", "url")).alias("sub"),
    )
    ambiguous = _names(hits, "req_id")
    # the registry's names: one row, joined to the requests that nothing matches
    available = sized(_names(registry.select("pos", "keyword")).select(F.lit("not_found").alias("tier"), F.col("names").alias("available")), "keywords")

    out = req.join(per_req, "req_id", "left").join(ambiguous, "req_id", "left")
    kw = F.col("keyword_or_url")
    n_sub = F.coalesce(F.col("n_sub"), F.lit(0))
    out = out.withColumn("_is_url", U.is_url(kw))
    tier = (F.when(kw.isNull() | (kw == ""), F.lit("empty"))
            .when(F.col("_is_url"), F.lit("url"))
            .when(F.col("exact_url").isNotNull(), F.lit("exact"))
            .when(F.col("ci").isNotNull(), F.lit("case_insensitive"))
            .when(n_sub == 1, F.lit("substring"))
            .when(n_sub > 1, F.lit("ambiguous"))
            .otherwise(F.lit("not_found")))
    # staged: tier is a column computed once, then read by url and error
    out = out.withColumn("tier", tier).join(available, "tier", "left")
    tier = F.col("tier")
    url = (F.when(tier == "url", kw).when(tier == "exact", F.col("exact_url"))
           .when(tier == "case_insensitive", F.col("ci.url")).when(tier == "substring", F.col("sub.url")))
    error = (F.when(tier == "empty", F.lit("keyword_or_url cannot be empty"))
             .when(tier == "ambiguous", F.concat(F.lit("Keyword '"), kw, F.lit("' matches multiple APIs: "),
                                                 F.col("names"), F.lit(". Please be more specific.")))
             .when(tier == "not_found", F.concat(F.lit("Keyword '"), kw,
                                                 F.lit("' not found in URL config. Available keywords: "),
                                                 F.coalesce(F.col("available"), F.lit("")))))
    return out.select("req_id", "keyword_or_url", tier.alias("tier"), url.alias("url"), error.alias("error"))


def infer_doc_type(seeds: DataFrame, registry: DataFrame) -> DataFrame:
    """seeds(seed_id, start_url) -> doc_type = keyword of the first registry
    entry (by pos) whose url is a substring of start_url or contains it;
    otherwise the host slug (netloc with '.' -> '_').  An empty registry url is
    in every start_url, and an empty start_url in every registry url."""
    s = seeds.select("seed_id", "start_url")
    reg = registry.select("pos", "keyword", "url")
    # registry url inside start_url: explode the seed's grams, probe with the url's probe
    s_grams = s.select("seed_id", "start_url",
                       F.explode(_key_grams(F.col("start_url"), _probe_lengths(reg, "url"))).alias("g"))
    a = (s_grams.join(reg.withColumn("g", _probe(F.col("url"))), "g")
         .where(F.instr("start_url", F.col("url")) > 0).select("seed_id", "pos", "keyword"))
    # start_url inside registry url: explode the registry's grams, probe with the seed's probe
    r_grams = reg.select("pos", "keyword", "url",
                         F.explode(_key_grams(F.col("url"), _probe_lengths(s, "start_url"))).alias("g"))
    b = (s.withColumn("g", _probe(F.col("start_url"))).join(r_grams, "g")
         .where(F.instr("url", F.col("start_url")) > 0).select("seed_id", "pos", "keyword"))
    first = a.unionByName(b).groupBy("seed_id").agg(F.min(F.struct("pos", "keyword")).alias("m"))
    # empty strings have no grams: one row with the first entry of all and the first without a url
    entry = F.when(F.col("url").isNotNull(), F.struct("pos", "keyword"))
    of_all = sized(reg.agg(F.min(entry).alias("any"), F.min(F.when(F.col("url") == "", F.struct("pos", "keyword"))).alias("blank"))
                   .withColumn("given", F.lit(True)), "first-entries")
    found = s.withColumn("given", F.col("start_url").isNotNull()).join(first, "seed_id", "left").join(of_all, "given", "left")
    found = found.withColumn("m", F.least("m", "blank", F.when(F.col("start_url") == "", F.col("any"))))
    return found.select(
        "seed_id", "start_url",
        F.coalesce(F.col("m.keyword"), U.host_slug("start_url")).alias("doc_type"),
        F.when(F.col("m").isNotNull(), F.lit("registry")).otherwise(F.lit("host")).alias("source"),
    )
