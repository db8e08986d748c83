"""Meaning-level search and bridging over text chunks with embeddings in an array column."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import WORD_EDGE, quarter_of
from ledgerloom.operators.profile import rank_within
from ledgerloom.operators.skew import broadcast_if_small, join_pairs

# Wording that makes a text specific, and capitalised words that do not.
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]?"
BILL = rf"{WORD_EDGE}[HS]\.?{_BLANK}[RJ]?\.?{_BLANK}\p{{Nd}}{{1,5}}{WORD_EDGE}"
CAPITALISED = rf"{WORD_EDGE}[A-Z][A-Za-z0-9&.\-]{{2,}}{WORD_EDGE}"
COMMON_CAPITALISED = ["The", "This", "Act", "Bill", "Issues", "House", "Senate", "Congress", "Federal", "United", "States", "General", "All"]
#: Bytes of query vectors that one scan carries.
_HELD = 64 << 20
_SPACE = r"[\s\u0085   -     　\u001c-\u001f]+"


def chunks(text: Column, size: int = 170, overlap: int = 40) -> Column:
    """Word windows of a text; one that fits in a window stays as it is, the last window is the first to reach the end."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    step = max(1, size - overlap)

    def cut_up(w: Column) -> Column:
        last = F.greatest(F.ceil((F.size(w) - size) / step).cast("int"), F.lit(0))
        windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))
        return F.when(F.size(w) <= size, F.array(text)).otherwise(windows)

    # The words are bound once, as the element of an array: a column used within a lambda is computed at every call of it.
    return F.when(text.isNotNull(), F.get(F.transform(F.array(words), cut_up), F.lit(0)))


def space(df: DataFrame, text: str, keys: list[str], carry: list[str] | None = None, where: str | None = None, size: int = 170, overlap: int = 40, limit: int | None = None, dedupe: bool = True, chunk: bool = True) -> DataFrame:
    """(*keys, *carry, chunk_index, text): the chunks of a text column, or whole texts, each distinct text once if asked.

    ``where`` is applied first, then ``limit`` in the order of the keys, then blank texts and further copies are dropped.
    The first holder of a text is a minimum per text, combined per task, so a text with very many copies is no hot spot.
    """
    rows = df.where(where) if where else df
    rows = rows.orderBy(*keys).limit(limit) if limit else rows
    rows = rows.withColumn("_t", F.trim(F.col(text))).where("_t IS NOT NULL AND _t <> ''")
    cols = list(dict.fromkeys([*keys, *(carry or [])]))
    if dedupe:
        rows = rows.groupBy("_t").agg(F.min_by(F.struct(*cols), F.struct(*keys)).alias("r")).select(*[F.col(f"r.`{c}`").alias(c) for c in cols], "_t")
    pieces = chunks(F.col("_t"), size, overlap) if chunk else F.array("_t")
    return rows.select(*cols, F.posexplode(pieces).alias("chunk_index", "text"))


def write_space(rows: DataFrame, keys: list[str], folder: str, name: str, encoder=None, about: dict | None = None) -> DataFrame:
    """Encode the texts of a space and write it anew: its rows with ``row_id`` (in the order of the keys) and ``embedding``
    of unit length, and beside them what it was made with.  ``encoder`` maps a text column to a vector column."""
    spark = rows.sparkSession
    ordered = rank_within(rows.withColumns({"_one": F.lit(0), "_at": F.struct(*keys, "chunk_index")}), "_one", "_at")
    raw = (encoder or hash_embedding)(F.col("text"))
    length = F.sqrt(dot(F.col("_v"), F.col("_v")))
    unit = F.transform("_v", lambda x: F.when(length > 0, x / length).otherwise(x).cast("float"))
    vectors = ordered.withColumn("_v", raw).withColumn("embedding", unit).withColumnRenamed("_rank", "row_id").drop("_one", "_at", "_v")
    vectors.write.mode("overwrite").parquet(f"{folder}/{name}/rows")
    back = spark.read.parquet(f"{folder}/{name}/rows")
    n, dims = back.agg(F.count("*"), F.max(F.size("embedding"))).first()
    meta = {"space": name, "n_vectors": n, "dims": dims or 0} | (about or {})
    spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(meta.items())], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}/meta")
    return back


def read_space(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, dict]:
    """The rows of a written space and what it was made with."""
    meta = {r["key"]: json.loads(r["value"]) for r in spark.read.parquet(f"{folder}/{name}/meta").collect()}
    return spark.read.parquet(f"{folder}/{name}/rows"), meta


def build_spaces(pack: dict, tables: dict[str, DataFrame], folder: str, encoder=None, only: str | None = None) -> dict[str, int]:
    """Build the spaces of a semantic pack, or the one named; vectors per space."""
    built = {}
    for s in pack.get("spaces", []):
        if only is None or s["name"] == only:
            size, overlap = s.get("chunk_words", pack.get("chunk_words", 170)), s.get("chunk_overlap", pack.get("chunk_overlap", 40))
            rows = space(tables[s["table"]], s["text_col"], s["id_cols"], s.get("carry_cols"), s.get("where"), size, overlap, s.get("limit"), s.get("dedupe", False), s.get("chunk", False))
            about = {"model": pack.get("model") if encoder else "hashed words", "chunked": s.get("chunk", False), "deduped": s.get("dedupe", False), "limit": s.get("limit")}
            built[s["name"]] = write_space(rows, s["id_cols"], folder, s["name"], encoder, about).count()
    return built


def hash_embedding(text: Column, dims: int = 256) -> Column:
    """A deterministic embedding that needs no model: signed hashed words, unit length (pluggable by any pandas UDF)."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        out = []
        for t in texts:
            v = np.zeros(dims, dtype=np.float32)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % dims] += 1.0 if (h >> 16) & 1 else -1.0
            n = float(np.linalg.norm(v))
            out.append(v / n if n else v)
        return pd.Series(out)

    return embed(text)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; of unit vectors, their cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def query_scores(space_: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int | None = None, block: int = 256) -> DataFrame:
    """(query_id, row_id, score) of a stated set of queries against all rows, in blocks on the executors.

    As many queries as fit into ``_HELD`` bytes are broadcast for one scan of the rows and multiplied with every batch in
    blocks of ``block``, so neither the driver's nor a task's memory grows with the number of queries.  With ``k`` a batch gives out only its own
    k best rows of each query (ties by row), which is all that a later best-k can need.  Null vectors have no scores.
    """
    spark = space_.sparkSession
    kinds = dict(queries.dtypes)[query_key], dict(space_.dtypes)[key]
    rows = space_.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v IS NOT NULL")

    def scored(held: list[tuple]) -> DataFrame:
        ids = np.array([h[0] for h in held])
        matrix = spark.sparkContext.broadcast(np.array([h[1] for h in held], dtype=np.float64))

        def run(frames):
            for f in frames:
                if not len(f):
                    continue
                own, vectors = f["k"].to_numpy(), np.vstack(f["v"].to_numpy()).astype(np.float64)
                for start in range(0, len(ids), block):
                    some, sims = ids[start : start + block], vectors @ matrix.value[start : start + block].T
                    if k is None or len(own) <= k:
                        yield pd.DataFrame({"query_id": np.tile(some, len(own)), "row_id": np.repeat(own, len(some)), "score": sims.ravel()})
                    else:
                        best = [np.lexsort((own, -sims[:, q]))[:k] for q in range(len(some))]
                        yield pd.DataFrame({"query_id": np.repeat(some, k), "row_id": np.concatenate([own[b] for b in best]), "score": np.concatenate([sims[b, q] for q, b in enumerate(best)])})

        return rows.mapInPandas(run, f"query_id {kinds[0]}, row_id {kinds[1]}, score double")

    out, held = None, []
    for r in queries.select(query_key, query_vector).where(F.col(query_vector).isNotNull()).orderBy(query_key).toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) * len(r[1]) * 8 >= _HELD:
            out, held = (scored(held) if out is None else out.unionByName(scored(held))), []
    if held:
        out = scored(held) if out is None else out.unionByName(scored(held))
    return out if out is not None else spark.createDataFrame([], f"query_id {kinds[0]}, row_id {kinds[1]}, score double")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query, ties by row.

    Best-of-slot first, then best overall: a query's scores are never gathered in one task.
    """
    order = [F.desc("score"), "row_id"]
    slot = scores.withColumn("_s", F.pmod(F.xxhash64("row_id"), F.lit(256)))
    part = slot.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_s").orderBy(*order))).where(F.col("_r") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).drop("_s", "_r")


def best_seed(scores: DataFrame) -> DataFrame:
    """(row_id, score, query_id): each row's best score over all seeds and the earliest seed that reaches it."""
    return scores.groupBy("row_id").agg(F.max("score").alias("score"), F.max_by("query_id", F.struct("score", -F.col("query_id"))).alias("query_id"))


def fuse_ranks(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """(row_id, fused): reciprocal-rank fusion of (row_id, rank) lists, for search by meaning and by words together."""
    both = rankings[0].select("row_id", "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select("row_id", "rank"))
    return both.groupBy("row_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("fused"))


def is_specific(text: Column, require_any: list[str] | None = None, drop_if_only: list[str] | None = None) -> Column:
    """Names a bill, or holds a capitalised word beyond the common ones; with ``require_any`` one of those patterns instead.

    A text that is nothing but phrases of ``drop_if_only`` (letter case, digits and punctuation aside) is not specific.
    """
    if require_any:
        hit = F.lit(False)
        for p in require_any:
            hit = hit | text.rlike(p)
    else:
        capitals = F.regexp_extract_all(text, F.lit(f"({CAPITALISED})"), 1)
        hit = text.rlike(BILL) | (F.size(F.array_except(capitals, F.array(*[F.lit(x) for x in COMMON_CAPITALISED]))) > 0)
    if drop_if_only:
        phrases = "|".join(re.escape(x.lower()) for x in sorted(drop_if_only, key=len, reverse=True))
        hit = hit & (F.regexp_replace(F.regexp_replace(F.lower(text), phrases, " "), r"[^\p{L}]+", "") != "")
    return hit


def anchors(parts: list[DataFrame]) -> DataFrame:
    """(member, client, strength): strongest known tie of each pair, over (member, client, strength) parts."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.select(F.col("member").cast("string").alias("member"), F.upper(F.trim("client")).alias("client"), "strength").groupBy("member", "client").agg(F.max("strength").alias("strength"))


def noise_floor(a: DataFrame, b: DataFrame, vector: str, order: str, percentile: float = 99.5, pairs: int = 20_000) -> float:
    """The similarity that unrelated pairs hardly ever exceed: a percentile over evenly spaced, aligned pairs."""
    def spaced(df: DataFrame) -> tuple[DataFrame, int]:
        n = df.count()
        m = min(pairs, n)
        ranked = rank_within(df.select(vector, order, F.lit(0).alias("_one")), "_one", order)
        at = F.sequence(F.ceil(F.col("_rank") * (m - 1) / max(n - 1, 1)).cast("int"), F.floor((F.col("_rank") + 1 - 1e-9) * (m - 1) / max(n - 1, 1)).cast("int"))
        hit = ranked.where(F.ceil(F.col("_rank") * (m - 1) / max(n - 1, 1)) <= F.floor((F.col("_rank") + 1 - 1e-9) * (m - 1) / max(n - 1, 1)))
        return hit.select(F.explode(at).alias("i"), F.col(vector).alias("v")), m

    (x, m), (y, k) = spaced(a), spaced(b)
    sims = x.withColumnRenamed("v", "p").join(y.withColumnRenamed("v", "q"), "i").where(F.col("i") < min(m, k)).select(dot(F.col("p"), F.col("q")).alias("s"))
    value = sims.agg(F.percentile("s", percentile / 100)).first()[0]
    return float("-inf") if value is None else float(value)


def anchored_scores(ties: DataFrame, press: DataFrame, descriptions: DataFrame, floor: float, margin: float = 0.08, same_quarter: bool = True) -> DataFrame:
    """Per tie (and quarter) the best press chunk, its best description, similarity and margin over the centroid.

    ``press``: member, year, quarter, chunk, vec.  ``descriptions``: client, year, quarter, chunk, vec.  Pairs are formed
    only within a tie's own member and client (and quarter); a client with very many of them is split over tasks, and as
    all pairs of a press chunk meet in one task, only its best leaves it.
    """
    when = ["year", "quarter"] if same_quarter else []
    k = ["client", *when]
    at = descriptions.select(*k, F.posexplode("vec").alias("i", "x"))
    means = at.groupBy(*k, "i").agg(F.avg("x").alias("m"))
    centre = means.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    norm = F.sqrt(dot(F.col("mean"), F.col("mean"))) + F.lit(1e-9)
    centre = centre.withColumn("centroid", F.transform("mean", lambda x: x / norm)).drop("mean")
    p = broadcast_if_small(ties).join(press.withColumnsRenamed({"chunk": "press_chunk", "vec": "_p"}), "member")
    pairs = join_pairs(p, descriptions.select(*k, F.col("chunk").alias("description_chunk"), F.col("vec").alias("_d")), k, "press_chunk").withColumn("sim", dot(F.col("_p"), F.col("_d")))
    best = pairs.groupBy("member", *k, "strength", "press_chunk").agg(F.max("sim").alias("sim"), F.max_by("description_chunk", F.struct("sim", -F.col("description_chunk"))).alias("description_chunk"), F.first("_p").alias("_p"))
    with_margin = best.join(centre, k).withColumn("margin", F.col("sim") - dot(F.col("_p"), F.col("centroid"))).drop("_p", "centroid")
    top = with_margin.groupBy("member", *k, "strength").agg(F.max_by(F.struct("press_chunk", "description_chunk", "sim", "margin"), F.struct("sim", -F.col("press_chunk"))).alias("b"))
    return top.select("member", *k, "strength", "b.*").where((F.col("sim") >= floor) & (F.col("margin") >= margin))


def rank_and_cap(scored: DataFrame, income: DataFrame, per_client: int = 3, top: int = 60) -> DataFrame:
    """The best pairs by (sim+margin)*log10(income)*(0.5+strength), at most ``per_client`` of one client, ``top`` in all."""
    totals = income.groupBy(F.upper("client").alias("client")).agg(F.sum("income").alias("income"))
    joined = scored.join(totals, "client", "left")
    weight = F.log10(F.greatest(F.lit(10.0), F.coalesce("income", F.lit(0)).cast("double")))
    ranked = joined.withColumn("rank", (F.col("sim") + F.col("margin")) * weight * (F.lit(0.5) + F.col("strength")))
    order = [F.desc("rank"), "member", "press_chunk"]
    own = F.row_number().over(Window.partitionBy("client").orderBy(*order))
    return ranked.withColumn("_n", own).where(F.col("_n") <= per_client).drop("_n").orderBy(*order).limit(top)


def with_quarter(df: DataFrame, date: str) -> DataFrame:
    year, quarter = quarter_of(F.col(date).cast("string"))
    return df.withColumns({"year": year, "quarter": quarter})


def _first_two(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select("_0", "_1")


def bridge(spark: SparkSession, pack: dict, tables: dict[str, DataFrame], folder: str, run: str) -> tuple[DataFrame, list[str]]:
    """Leads of a pack's bridge over its written spaces, and why some of its anchors were left out.

    The columns the spaces are read by have the documented names as defaults (``press_member_col``, ``press_date_col``,
    ``desc_client_col``, ``desc_year_col``, ``desc_period_col``); ``income_sql`` gives (client, income).  An anchor whose
    SQL fails is skipped.  With ``same_quarter`` false pairs need not share a quarter.
    """
    b = pack["bridge"]
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    parts, skipped = [], []
    for a in b["anchors"]:
        try:
            found = _first_two(spark.sql(a["sql"])).select(F.col("_0").cast("string").alias("member"), F.col("_1").cast("string").alias("client"), F.lit(float(a.get("strength", 1.0))).alias("strength"))
            parts.append(found.where("member IS NOT NULL AND member <> '' AND client IS NOT NULL AND client <> ''"))
        except Exception as e:  # noqa: BLE001 - one anchor must not stop the others
            skipped.append(f"{a.get('name')}: {str(e).splitlines()[0]}")
    ties = anchors(parts) if parts else spark.createDataFrame([], "member string, client string, strength double")
    same = b.get("same_quarter", True)
    (press, about), (desc, _) = read_space(spark, folder, b["press_space"]), read_space(spark, folder, b["desc_space"])
    year, quarter = quarter_of(F.col(b.get("press_date_col", "pub_date")).cast("string")) if same else (F.lit(None).cast("string"),) * 2
    p = press.select(F.col(b.get("press_member_col", "member_bioguide")).cast("string").alias("member"), year.alias("year"), quarter.alias("quarter"), F.col("row_id").alias("chunk"), F.col("embedding").alias("vec"))
    p = p.where("member IS NOT NULL AND member <> ''" + (" AND year IS NOT NULL" if same else ""))
    client = F.upper(F.trim(F.col(b.get("desc_client_col", "client_name")).cast("string")))
    when = [F.col(b.get("desc_year_col", "filing_year")).cast("string").alias("year"), F.col(b.get("desc_period_col", "period_norm")).cast("string").alias("quarter")] if same else [F.lit(None).cast("string").alias("year"), F.lit(None).cast("string").alias("quarter")]
    rule = b.get("specificity_filter")
    d = desc.where(is_specific(F.col("text"), rule.get("require_any"), rule.get("drop_if_only"))) if rule else desc
    d = d.select(client.alias("client"), *when, F.col("row_id").alias("chunk"), F.col("embedding").alias("vec")).where("client <> ''")
    left_out = sorted({x.strip().upper() for x in [*b.get("exclude_clients", []), *b.get("exclude_clients_upper", [])]})
    d = d.where(~F.col("client").isin(left_out)) if left_out else d
    floor = max(noise_floor(press, desc, "embedding", "row_id", b.get("null_percentile", 99.5)), b.get("min_floor", 0.0))
    scored = anchored_scores(ties, p, d, floor, b.get("min_margin_over_centroid", 0.08), same)
    income = spark.createDataFrame([], "client string, income double")
    if b.get("income_sql"):
        income = _first_two(spark.sql(b["income_sql"])).select(F.col("_0").cast("string").alias("client"), F.col("_1").cast("double").alias("income"))
    chosen = rank_and_cap(scored, income, b.get("per_client_cap", 3), b.get("top_n", 60))
    text = lambda s: s.select(F.col("row_id").alias("chunk"), "text", *[F.col(c).cast("string").alias(c) if c in s.columns else F.lit(None).cast("string").alias(c) for c in ("source_group", "native_id")])
    return semantic_leads(chosen, text(press), text(desc), run, innocent=b.get("innocent_explanations")), skipped


def semantic_leads(chosen: DataFrame, press: DataFrame, descriptions: DataFrame, run: str, detector: str = "semantic_say_do_anchored", cut_at: int = 240, innocent: list[str] | None = None) -> DataFrame:
    """Leads of the chosen pairs: both texts cut to ``cut_at`` characters, their locators, and how to repeat the search.

    ``press`` and ``descriptions``: chunk, text, source_group, native_id.
    """
    p = press.select(F.col("chunk").alias("press_chunk"), F.substring("text", 1, cut_at).alias("_pt"), F.col("source_group").alias("_pg"), F.col("native_id").alias("_pi"))
    d = descriptions.select(F.col("chunk").alias("description_chunk"), F.substring("text", 1, cut_at).alias("_dt"), F.col("source_group").alias("_dg"), F.col("native_id").alias("_di"))
    rows = broadcast_if_small(chosen).join(p, "press_chunk").join(d, "description_chunk")
    item = lambda t, g, i, v: F.struct(F.lit(t).alias("table"), F.array(F.struct(F.col(g).alias("source_group"), F.col(i).alias("native_id"))).alias("locators"), F.struct(F.col(v).alias("value")).alias("values"))
    claim = F.concat("member", F.lit(" speaks as "), "client", F.lit(" lobbies: "), F.format_string("similarity %.3f, margin %.3f", "sim", "margin"))
    repeat = F.concat(F.lit("anchored_scores member="), "member", F.lit(" client="), "client")
    return rows.select(
        F.lit(detector).alias("detector_id"), F.lit("semantic_overlap").alias("template"), F.lit("semantic_overlap").alias("signal_type"), claim.alias("claim"), F.col("rank").alias("score"), F.lit(None).cast("double").alias("rank_score"),
        F.lit("new").alias("status"), F.lit(0).alias("legal_flag"), F.lit("named_person").alias("defamation_tier"), F.to_json(F.array(item("press", "_pg", "_pi", "_pt"), item("descriptions", "_dg", "_di", "_dt"))).alias("evidence"),
        F.to_json(F.struct(repeat.alias("repeat"))).alias("params"), F.lit(json.dumps(innocent if innocent is not None else ["Shared topic of the day", "Same public source quoted by both"])).alias("innocent_explanations"), F.lit(run).alias("created_run"),
    )
