"""Candidates from a language model: requests, an injected client, and the reading of its answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lang as L
from ..functions import text as T

# fixed values: temperature and number of answers of each round
ROUNDS = {1: (0.8, 6), 2: (0.6, 4)}
# fixed values: what the second round asks, around the text and the list of its low words
ASK = {
    "en": ("Original sentence:\n", "\n\nLow-frequency words to replace (lower = rarer):\n", "\n\nReplace only these words, generate 4 versions:"),
    "zh": ("原始句子：\n", "\n\n需要替换的低频词（分数越低越需要换）：\n", "\n\n请只替换这些词，生成 4 个版本："),
}
LOW_WORD = '  - "%s" (频率分: %.1f)'


def answer_lines(answer: Column, round_no: int = 1) -> Column:
    """array<string>: trimmed lines without list numbers, over five UTF-16 units, the first six or four."""
    trim = lambda x: F.regexp_replace(x, rf"\A[{T.WS}]+|[{T.WS}]+\z", "")
    lines = F.filter(F.transform(F.split(answer, "\n"), trim), lambda x: x != "")
    clean = F.transform(lines, lambda x: trim(F.regexp_replace(x, rf"\A[0-9]+[.)、][{T.WS}]*", "")))
    return F.slice(F.filter(clean, lambda x: F.octet_length(F.encode(x, "UTF-16BE")) > 10), 1, ROUNDS[round_no][1])


def candidate_rows(answers: DataFrame, key: str, answer: str = "answer", round_no: int = 1) -> DataFrame:
    return answers.select(key, F.posexplode(answer_lines(F.col(answer), round_no)).alias("pos", "text"))


def low_word_requests(lowest: DataFrame, key: str) -> DataFrame:
    """(key, words): one line `"word" (score)` for each low token, lowest first."""
    line = F.format_string(LOW_WORD, "token", "zipf")
    w = lowest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("a"))  # a fixed number a prompt
    return w.select(key, F.array_join(F.transform("a", lambda x: x["l"]), "\n").alias("words"))


def replace_requests(texts: DataFrame, words: DataFrame, key: str, text: str = "text", least: int = 2) -> DataFrame:
    """(key, prompt): the second round's question about each text (key, text) with the words of low_word_requests(), in
    the text's language. Texts with fewer than `least` low words get none."""
    own = lambda i: F.when(L.detect_language(F.col(text)) == "zh", ASK["zh"][i]).otherwise(ASK["en"][i])
    w = words.filter(F.size(F.split("words", "\n")) >= least)
    return texts.join(w, key).select(key, F.concat(own(0), F.col(text), own(1), F.col("words"), own(2)).alias("prompt"))


def ask(requests: DataFrame, client: Callable[[str, float], str], key: str, prompt: str, round_no: int = 1) -> DataFrame:
    """(key, answer, error): calls an injected client on the executors; a failed call leaves its message."""
    temperature = ROUNDS[round_no][0]

    def run(batches):
        for b in batches:
            out = []
            for k, p in zip(b[key], b[prompt]):
                try:
                    out.append((k, client(p, temperature), None))
                except Exception as e:
                    out.append((k, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    return requests.select(key, prompt).mapInPandas(run, f"{key} {requests.schema[key].dataType.simpleString()}, answer string, error string")


def recent_per_key(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("pos"))).filter(F.col("_r") <= n).drop("_r")
