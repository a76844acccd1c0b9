"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, licences, merkle, quality
from .common import map_rows, table
from .decontaminate import contaminated
from .mixing import mix
from .periodic_runs import periodic_runs
from .pseudonyms import pseudonymize
from .secret_scan import scan_secrets
from .sentencepiece_chunks import encode
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .toxicity import fit, score_toxicity


#: Target weights: the larger the number in a source's name, the smaller its share.
WEIGHTS = {f"src{i}": Fraction(1, 1 + i % 5) for i in range(20)}


def op1_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with format-preserving pseudonyms and counts of replaced values.

    Without ``spark.skyledger.pseudonyms.secret`` the key is drawn for the session, so pseudonyms differ from run to run.
    """
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(licences.document_files(table(spark, sf_dir, "documents")))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block, slot and position; the text stays where it is."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), WEIGHTS)


#: Samples that a query clip lacks on either side (20 frames), and its noise.
CLIP, NOISE = 20 * chroma.HOP, 0.02


def op5_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings are the vectors of ``embeddings`` played as melodies; each twentieth id also
    gives a noisy excerpt, searched for in all recordings."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    whole = map_rows(vectors, lambda: lambda i, v: (i, chroma.fingerprint(chroma.melody(v))), "media_id long, codes array<int>")
    clip = map_rows(vectors.where(F.col("vec_id") % 20 == 0), lambda: lambda i, v: (i, chroma.fingerprint(chroma.melody(v, skip=CLIP, noise=NOISE, seed=i))), "media_id long, codes array<int>")
    return chroma.search(whole, clip)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=merkle.without_line_feeds())


#: On every executor.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op12_sentencepiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model=PIECES, ids=False)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True).drop("collapsed")


QUERIES = {
    f.__name__: f
    for f in (
        op1_weak_label_quality,
        op2_feistel_pseudonyms,
        op3_licence_scan,
        op4_pfair_mixing,
        op5_chroma_fingerprints,
        op6_simhash_near_dedup,
        op7_suffix_array_dedup,
        op8_secret_scan,
        op9_compression_toxicity,
        op10_spaced_seed_decontamination,
        op11_merkle_manifest,
        op12_sentencepiece_chunks,
        op13_periodic_runs,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_licence_scan": licences.oracle_sql(), "op11_merkle_manifest": merkle.oracle_sql()}
