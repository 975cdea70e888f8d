"""The queries of the operators in this subpackage, each over its whole tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpus_pipeline import run as pipeline
from visitseq.llm import (
    alignment, chat, decontaminate, idfiles, licences, lmscore, neighbours, packing, personal,
    quality, secrets, similarity, spelling)
from visitseq.sources import materialize, scratch_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_nearest(spark, sf):
    return neighbours.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding",
                              F.col("vec_id") % 50 == 0)


def op2_chat(spark, sf):
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


def op3_quality(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.learn(docs, labels.filter(~quality.held_out()))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_decontaminate(spark, sf):
    found = decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        "contaminated")


def op5_secrets(spark, sf):
    found = secrets.find_secrets(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))

    def count(rank):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(rank).alias(f"n_{kind}") for rank, (kind, *_) in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.as_text(base), 256).alias("base_sha256"),
                        secrets.as_text(F.col("spans")).alias("spans"))


def op6_id_files(spark, sf):
    path = scratch_path(spark, "id-files")
    idfiles.write_ids(table(spark, sf, "documents"), path)
    return idfiles.read_ids(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_licences(spark, sf):
    found = licences.scan_licences(table(spark, sf, "documents"), licences.known_licences(spark))
    return found.select("doc_id", F.array_join("whole", ",").alias("whole"),
                        F.array_join("lines", ",").alias("licences"),
                        F.size("lines").cast("long").alias("n_licences"))


def op8_lm_score(spark, sf):
    docs = table(spark, sf, "documents")
    return lmscore.score(docs, *lmscore.learn(docs))


def op9_similar(spark, sf):
    return similarity.similar(table(spark, sf, "documents"))


def op10_pack(spark, sf):
    return packing.pack(table(spark, sf, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_align(spark, sf):
    groups = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = materialize(alignment.align(table(spark, sf, "documents")).select(
        "doc_id", "n_a", "n_b", "n_groups", groups.alias("groups_sha256"), "links"), "aligned")
    return alignment.weigh(aligned, alignment.link_counts(aligned)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_spelling(spark, sf):
    return spelling.group_variants(table(spark, sf, "documents"))


def op13_personal(spark, sf):
    found = personal.find_personal(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(rank):
        return F.size(F.filter(base, lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id", *[count(rank).alias(f"n_{kind}") for rank, kind in enumerate(personal.KINDS)],
        F.sha2(personal.as_text(base), 256).alias("base_sha256"),
        personal.as_text(F.col("spans")).alias("spans"))


QUERIES = {
    "pipeline": pipeline,
    "op1_nearest": op1_nearest,
    "op2_chat": op2_chat,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_secrets": op5_secrets,
    "op6_id_files": op6_id_files,
    "op7_licences": op7_licences,
    "op8_lm_score": op8_lm_score,
    "op9_similar": op9_similar,
    "op10_pack": op10_pack,
    "op11_align": op11_align,
    "op12_spelling": op12_spelling,
    "op13_personal": op13_personal,
}
