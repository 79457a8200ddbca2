"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import os
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, media, mixing, packing, periodic, quality, resharding, simhash, suffixdedup, topk, toxicity, warc, whitening
from .common import columns, scratch_path, set_aside, stored, table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers' files lie; another folder can be named in PUBLIC_TOKENIZERS."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.Toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = model.scores(docs).select("doc_id", toxicity.held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.ImportanceResampler.fit(docs, table(spark, sf_dir, "labels"), train_on=~toxicity.held_out())
    return model.scores(docs).select("doc_id", toxicity.held_out().alias("held_out"), F.col("qr_ratio").alias("log_ratio"), F.col("qr_key").alias("gumbel_key"), F.col("qr_keep").alias("kept"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantise().alias("v"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, 20)


#: Text in one file of op4's shards.
UNIT_BYTES = 4 << 20


def op4_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 12 old shards by checksum, written as files, to 16 of equal bytes: what comes back is read from the new layout."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    path = resharding.write_layout(docs, F.pmod(crc, F.lit(12)), scratch_path(spark, "shards"), unit_bytes=UNIT_BYTES)
    resharding.reshard(spark, path, 16)
    shards = resharding.read_layout(spark, path)
    return shards.select("doc_id", F.col("rs_size").alias("size"), F.col("rs_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("rs_shard").alias("shard"), F.col("rs_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams are written to a table, and all but the length of the text is worked out from what is read back."""
    return media.describe(stored(media.encode_texts(table(spark, sf_dir, "documents")), "media", "zstd"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokens(docs: DataFrame) -> DataFrame:
    """Token ids of each text, and the digest of what they decode to."""
    coded = docs.select("doc_id", bpe.round_trip(docs, vocabulary_path()).alias("t"))
    return coded.select("doc_id", (F.octet_length("t.ids") / 4).cast("long").alias("n_tokens"), F.sha2("t.ids", 256).alias("ids_sha256"), F.sha2(F.col("t.decoded").cast("binary"), 256).alias("decoded_sha256"))


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents' columns but the text, its token ids (little-endian unsigned 32-bit integers in a binary column, read with
    numpy.frombuffer or ``bpe.ids_array``), their number, and digests of them and of what they decode to."""
    docs, put_back = set_aside(docs, ["ids", "n_tokens", "ids_sha256", "decoded_sha256", "bpe_coded"])
    coded = docs.withColumn("bpe_coded", bpe.round_trip(docs, vocabulary_path()))
    ids = F.col("bpe_coded.ids")
    new = [ids.alias("ids"), (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("bpe_coded.decoded").cast("binary"), 256).alias("decoded_sha256")]
    return put_back(coded.select(*columns([c for c in docs.columns if c != "text"]), *new))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Repeated passages of over 50 words, whatever their bytes, are reported beside op9's 400 bytes.
PASSAGE = 51


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns, passage_words: the words in passages of 51 words or more that stand anywhere else too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffixdedup.with_kept_sha256(suffixdedup.with_spans(suffixdedup.with_passages(docs, PASSAGE)))
    return found.select(
        "doc_id",
        F.col("sd_bytes").alias("n_bytes"),
        suffixdedup.span_total("sd_spans").alias("n_removed"),
        F.size("sd_spans").cast("long").alias("n_spans"),
        "kept_sha256",
        suffixdedup.span_total("sd_passages").alias("passage_words"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns, the size of each piece's sequence and the step group that the sequence is dealt to."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    names = {"pk_start": "start", "pk_length": "length", "pk_tokens": "doc_tokens", "pk_sequence": "sequence_id", "pk_offset": "offset", "pk_tier": "tier", "pk_step": "step_group"}
    return packed.select("doc_id", *[F.col(c).alias(n) for c, n in names.items()], F.crc32("pk_ids").alias("ids_crc32"))


def planted_period(n: int, doc_id: str | None):
    """Places of the words that make the text searched by op12: every tenth document, by a checksum of its id, gets a
    period in its later part. A null id leaves the text as it is."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are made of the operator's runs and collapsed texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").cast("string").alias("name"))
    found = periodic.collapsed(docs, order=planted_period, order_col="name")
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("pr_runs", none, lambda b, r: F.when(better(b, r), r).otherwise(b))
    lines = F.array_join(F.transform("pr_runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("pr_runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("pr_runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("pr_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", *[F.col(f"wh_{c}").alias(c) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")])


def queries() -> dict:
    all_of_them = (
        op1_toxicity, op2_quality, op3_topk, op4_resharding, op5_media, op6_simhash, op7_bpe, op8_warc, op9_suffix, op10_mixing, op11_packing, op12_periodic, op13_whitening,
    )
    return {f.__name__: f for f in all_of_them}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_topk": """
            WITH c AS (SELECT DISTINCT vec_id, i, CAST(floor(CAST(embedding[i] AS DOUBLE) * 64) AS BIGINT) AS x
                       FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
                  FROM c AS q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op8_warc": """
            WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
                   CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
        "op10_mixing": """
            WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
            s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
            w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
            c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS room FROM w),
            r AS (SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE)
                             - coalesce(sum(cap) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                            / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c),
            t AS (SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM r WHERE room >= level)) AS target FROM r),
            j AS (SELECT doc_id, size, source_size, target, least(3.0::DOUBLE, target / source_size) AS rate,
                         CAST('0x' || substr(md5(concat('20', chr(31), CAST(doc_id AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
                  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
            SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM j""",
    }
