"""Requests and replies as JSON text, a row each: bodies are read by built-in JSON functions and fail open.

A body that is no JSON, or lacks a field its operator needs, is answered with that operator's neutral reply (no
sentences, no candidates, nothing missing, kept whole, no relation), never with an error; null bodies as malformed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import verify

SLOT = "struct<kind:string,text:string>"


def sentences(requests: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """Bodies are arrays of strings -> (key, pos, text); an array with another member than strings is malformed."""
    read = F.from_json(F.col(body), "array<string>")
    # the reader turns numbers and objects into strings, so the members' own types are looked at
    strings = F.forall(F.from_json(F.col(body), "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    r = requests.select(key, F.when(strings, read).alias("_s"))
    return r.select(key, F.posexplode("_s").alias("pos", "text"))


def optimize_requests(requests: DataFrame, key: str = "id", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Bodies {original, candidates} -> originals (key, text), an empty one where malformed, and candidates (key, pos,
    text)."""
    r = F.from_json(F.col(body), "original string, candidates array<string>")
    ok = r["original"].isNotNull() & r["candidates"].isNotNull() & F.coalesce(F.forall(r["candidates"], lambda x: x.isNotNull()), F.lit(False))
    read = requests.select(key, F.when(ok, r).alias("r"))
    return read.select(key, F.coalesce("r.original", F.lit("")).alias("text")), read.select(key, F.posexplode("r.candidates").alias("pos", "text"))


def structure_replies(requests: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """Bodies {original_slots, candidate_text} -> (key, reply): an array of {kind, text, issue} of what is missing."""
    r = F.from_json(F.col(body), f"original_slots array<{SLOT}>, candidate_text string")
    ok = r["original_slots"].isNotNull() & r["candidate_text"].isNotNull()
    lost = F.filter(r["original_slots"], lambda s: S.needs_exact(s["kind"]) & ~F.contains(r["candidate_text"], s["text"]))
    issues = F.transform(lost, lambda s: F.struct(s["kind"].alias("kind"), s["text"].alias("text"), F.lit("missing").alias("issue")))
    return requests.select(key, F.coalesce(F.when(ok, F.to_json(issues)), F.lit("[]")).alias("reply"))


def verify_replies(requests: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """Bodies {original_slots, similarities: [{text, similarity}], thresholds} -> (key, preservation, passes). Malformed
    ones and those without slots pass with 1.0. Similarities belong to the slots by place."""
    r = F.from_json(F.col(body), f"original_slots array<{SLOT}>, similarities array<struct<text:string,similarity:double>>, thresholds map<string,double>")
    ok = r["original_slots"].isNotNull() & r["similarities"].isNotNull()
    read = requests.select(key, F.when(ok, r).alias("r"))
    each = read.select(key, F.posexplode("r.original_slots").alias("slot_ord", "s"), "r.similarities", "r.thresholds")
    kind, given = F.col("s.kind"), F.try_element_at("similarities", F.col("slot_ord") + 1)
    similarity = F.coalesce(verify.exact_verdict(kind, F.col("s.text"), given["text"]), given["similarity"], F.lit(0.0))
    limit = F.coalesce(F.try_element_at(F.col("thresholds"), kind), S.threshold(kind))
    v = each.select(F.col(key).alias("id"), kind.alias("kind"), similarity.alias("similarity"), verify.passes(kind, similarity, limit).alias("passes"))
    return verify.preservation(v, requests.select(F.col(key).alias("id"))).select(F.col("id").alias(key), "preservation", "passes")


def substitution_requests(requests: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """Bodies {original, candidate} -> (key, original, candidate); both null where malformed."""
    r = F.from_json(F.col(body), "original string, candidate string")
    ok = r["original"].isNotNull() & r["candidate"].isNotNull()
    return requests.select(key, F.when(ok, r["original"]).alias("original"), F.when(ok, r["candidate"]).alias("candidate"))


def substitution_reply(verdict: Column, read: Column) -> Column:
    """The reply of a verdict; of a malformed body (`read` false) that of no relation."""
    v = F.when(read, verdict).otherwise("Unrelated")
    return F.to_json(F.struct(v.alias("verdict"), S.is_safe(v).alias("is_safe"), S.verdict_label(v).alias("label")))


def domain_tokens(requests: DataFrame, body: str = "body") -> DataFrame:
    """Bodies {name, lang, tokens} -> (name, lang, token); malformed ones add nothing."""
    r = F.from_json(F.col(body), "name string, lang string, tokens array<string>")
    ok = r["name"].isNotNull() & r["lang"].isNotNull() & r["tokens"].isNotNull()
    return requests.select(F.when(ok, r).alias("r")).select("r.name", "r.lang", F.explode("r.tokens").alias("token"))
