"""The queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm import alignment, chat, common, decontam, embeddings, lm, periodic, pieces, quality, rules, sharding, simhash, sql, substring, warc


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_of_id():
    return F.crc32(F.col("doc_id").cast("string"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return sharding.shard(docs, 16).select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.archive_pages(common.table(spark, sf_dir, "pages"), common.scratch_path(spark, "archives"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(common.table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    say = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", say), (-1, 1, "assistant", say)], rows.schema)
    template = chat.Template()
    return chat.read_back(chat.segments(rows.unionByName(more), template), template)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), crc_of_id() % 4 != 2)
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_of_id() % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(common.table(spark, sf_dir, "documents"), tokenizer_path())


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and test item that it leaks."""
    return decontam.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(common.table(spark, sf_dir, "documents"), crc_of_id() % 7 != 2)
    return scored.withColumn("held_out", F.coalesce(crc_of_id() % 7 == 2, F.lit(False)))


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rules.evaluate(common.table(spark, sf_dir, "documents"))
    base, verdict = rules.BASE, rules.POLICIES[1]
    judged = rules.verdicts(ledger, (base, verdict))
    kept = F.col(f"kept_v{base.version}") & F.col(f"kept_v{verdict.version}")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col(f"kept_v{base.version}")).alias("base_failed"), kept.alias("kept"), "n_lines", F.col("bits").alias("failed_rules"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the tail of one text in ten, by the hash of its id, made periodic."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    own = docs.withColumn("h", crc_of_id()).withColumn("g", F.expr("h div 10"))
    chosen = own.withColumn("w", F.when(F.col("h") % 10 == 0, words).otherwise(F.array().cast("array<string>"))).withColumn("n", F.size("w"))
    drawn = chosen.withColumn("a", F.when(F.col("n") > 0, F.expr("g % greatest(n, 1)"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.array_join(F.expr("transform(w, (x, i) -> w[int(if(i < a, i, a + (i - a) % p))])"), " ")
    return drawn.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_planted_runs(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = found.withColumn("best", periodic.most_periods(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version does, from the ledger."""
    return rules.ablations(rules.evaluate(common.table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embeddings, op2_sharding, op3_warc, op4_substring, op5_simhash, op6_chat, op7_quality, op8_sentencepiece, op9_decontamination, op10_lm_scoring, op11_rules, op12_runs, op13_alignment, rule_ablations)}


def oracle_sql() -> dict[str, str]:
    return {"op1_embeddings": sql.OP1, "op3_warc": sql.OP3, "op4_substring": sql.OP4, "op6_chat": sql.OP6, "op11_rules": sql.OP11, "rule_ablations": sql.ABLATIONS}
