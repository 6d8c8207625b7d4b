"""The queries opN_<name>, one for each operator, over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, chat, collocations, decontaminate, merkle, nra, quality, repeats, secrets, sharding, simhash, superminhash, toxicity
from lodestone.llm.common import table


def _over(operator: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, name) for name in names))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merkle_fingerprints": _over(merkle.op1_merkle_fingerprints, "documents"),
    "op2_toxicity": _over(toxicity.op2_toxicity, "documents", "labels"),
    "op3_chat_formatting": _over(chat.op3_chat_formatting, "conversations"),
    "op4_bpe": _over(bpe.op4_bpe, "documents"),
    "op5_secret_scan": _over(secrets.op5_secret_scan, "documents"),
    "op6_quality": _over(quality.op6_quality, "documents", "labels"),
    "op7_decontamination": _over(decontaminate.op7_decontamination, "documents", "benchmark"),
    "op8_simhash": _over(simhash.op8_simhash, "documents"),
    "op9_jump_sharding": _over(sharding.op9_jump_sharding, "documents"),
    "op10_repeated_passages": _over(repeats.op10_repeated_passages, "documents"),
    "op11_nra_search": _over(nra.op11_nra_search, "documents", "benchmark"),
    "op12_collocations": _over(collocations.op12_collocations, "documents"),
    "op13_superminhash": _over(superminhash.op13_superminhash, "documents"),
}

ORACLES: dict[str, str] = {
    "op3_chat_formatting": chat.ORACLE, "op11_nra_search": nra.ORACLE, "op12_collocations": collocations.ORACLE, "op13_superminhash": superminhash.ORACLE,
}
