"""Spaces that recognition dropped, put back: the cheapest way to cut a run of letters into words that a corpus has.

What words cost is learned from a table of texts: the rarer, the dearer. Only the table of costs, of bounded length, goes to the tasks; texts
stay where they are, and tokens that come again are looked up.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import lexicon as lx
from wardline.functions.spans import extended

#: Words that costs are kept of, the most frequent ones; occurrences that make a word; tokens that a task remembers.
VOCABULARY, LEAST, REMEMBERED = 200_000, 2, 50_000
#: Letters that words are looked up by, and the longest token that is remembered.
HEAD, TOKEN = 4, 40
#: Letters that are words; shorter runs are left alone.
SINGLE, SHORTEST = frozenset("ai"), 4
# Tokens that are links or addresses, a sentence's end glued to the next, and contractions.
LINKLIKE = re.compile(r"(https?://|hxxps?://|www\.|@|\.[a-z]{2,6}(/|\b))", re.I)
ADDRESS = re.compile(r"https?://|www\.|@", re.I)
GLUED_END = re.compile(r"(?<=[a-z])([.!?])(?=[A-Z][a-z])")
CONTRACTION = re.compile(r"([^\W\d_]+'(?:ve|m|re|s|t|ll|d))([^\W\d_]{3,})", re.I)
_ATOMS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]*)*|[\d]+|[,?!;:]+|[^\w,?!;:]+|_+|'+")


def word_costs(texts: DataFrame, text: str, most: int = VOCABULARY, least: int = LEAST) -> DataFrame:
    """(word, cost): words in lower case that occur at least `least` times, the `most` most frequent ones (ties: in their order), and the negative
    logarithm of their share of all words."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    top = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)
    return top.join(F.broadcast(total)).select("word", (-F.log(F.col("n") / F.col("total"))).alias("cost"))


class Speller:
    """Cuts runs of letters and puts spaces between the parts of tokens. Words of keep are whole, whatever they cost."""

    def __init__(self, costs: dict[str, float], keep=()):
        dearest = max(costs.values(), default=0.0)
        self.costs = {w.lower(): dearest for w in keep} | costs
        sizes: dict[str, set[int]] = {}
        for w in self.costs:
            if len(w) > 1 or w in SINGLE:
                sizes.setdefault(w[:HEAD], set()).add(len(w))
        # a head has the lengths of the shorter words that it begins with, too
        self.sizes = {head: tuple(sorted(set().union(*(sizes.get(head[:k], ()) for k in range(1, len(head) + 1))))) for head in sizes}
        self.remembered = lru_cache(REMEMBERED)(self._token)

    def token(self, token: str) -> str:
        return self.remembered(token) if len(token) <= TOKEN else self._token(token)

    def known(self, word: str) -> bool:
        return word.lower() in self.costs

    def pieces(self, run: str) -> list[str]:
        """The cheapest words that make up a run; the run itself if it is short, known, or can't be cut. Of equal ways that whose last words are shorter.

        From each place that can be reached, only lengths of words that begin with the letters there are tried, however long the longest word is."""
        n, low = len(run), run.lower()
        if n < SHORTEST or low in self.costs or len(low) != n:
            return [run]
        best, step, costs, sizes = [0.0] + [math.inf] * n, [0] * (n + 1), self.costs, self.sizes
        for start in range(n):
            if best[start] == math.inf:
                continue
            for head in range(HEAD, 0, -1):
                found = sizes.get(low[start : start + head])
                if found is not None:
                    break
            else:
                continue
            for size in found:
                end = start + size
                if end > n:
                    break
                word = costs.get(low[start:end])
                # later starts are shorter last words
                if word is not None and best[start] + word <= best[end]:
                    best[end], step[end] = best[start] + word, size
        if best[n] == math.inf:
            return [run]
        out = []
        while n:
            out.append(run[n - step[n] : n])
            n -= step[n]
        return out[::-1]

    def words(self, run: str) -> list[str]:
        """A run of letters and apostrophes as words: a contraction's tail is cut, other runs with apostrophes are left alone."""
        short = CONTRACTION.fullmatch(run)
        return [short[1], *self.pieces(short[2])] if short else self.pieces(run) if run.isalpha() else [run]

    def _token(self, token: str) -> str:
        """A token without spaces: words are cut, and a space goes between two words, between digits and a known word of three letters or
        more, and behind signs that end a part."""
        if LINKLIKE.search(token):
            return token
        atoms = []
        for part in _ATOMS.findall(token):
            atoms += [(w, "word") for w in self.words(part)] if part[0].isalpha() else [(part, "digits" if part[0].isdigit() else "stop" if part[0] in ",?!;:" else "sign")]
        out = [atoms[0][0]] if atoms else [token]
        whole = lambda a: a[1] == "word" and len(a[0]) >= 3 and self.known(a[0])
        for a, b in zip(atoms, atoms[1:], strict=False):
            apart = a[1] == b[1] == "word" or (a[1] == "digits" and whole(b)) or (b[1] == "digits" and whole(a)) or a[1] == "stop"
            out += [" " + b[0] if apart else b[0]]
        return "".join(out)

    def text(self, text: str) -> str:
        tokens = [t if ADDRESS.search(t) else GLUED_END.sub(r"\1 ", t) for t in text.split(" ")]
        return re.sub(r" {2,}", " ", " ".join(self.token(t) for t in " ".join(tokens).split(" ")))


def protected_words() -> list[str]:
    """Names and keys of brands that are one word."""
    return sorted({w for key, _, _, _, aliases, exact in lx.BRANDS for w in (key, *aliases, *exact) if w.isalpha()})


def respace(df: DataFrame, text: str, costs: DataFrame, out: str = "respaced") -> DataFrame:
    """df with the text whose dropped spaces are put back. Null texts stay null, links and addresses as they are. costs is what
    word_costs() returns: a row for each word, VOCABULARY at most."""
    spark = df.sparkSession
    told = spark.sparkContext.broadcast({r["word"]: r["cost"] for r in costs.limit(VOCABULARY).collect()})
    keep, made = protected_words(), {}

    def make(batch: pa.RecordBatch) -> pa.Array:
        speller = made.get("speller") or made.setdefault("speller", Speller(told.value, keep))
        return pa.array([None if t is None else speller.text(t) for t in batch.column(batch.schema.get_field_index("__glued")).to_pylist()], pa.string())

    return extended(df.withColumn("__glued", F.col(text)), out, T.StringType(), make).drop("__glued")


GAPS = T.StructType().add("taken", "long").add("back", "long").add("elsewhere", "long")


def gap_counts(batch: pa.RecordBatch) -> pa.Array:
    """Of columns text, glued and respaced: how many spaces were taken out, came back where they were, and came elsewhere. A space's place is the
    number of other characters before it."""

    def places(text: str) -> np.ndarray:
        space = np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32
        return np.unique(np.cumsum(~space)[space])

    out = []
    for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "glued", "respaced")), strict=True):
        text, left, respaced = map(places, row)
        taken, put = np.setdiff1d(text, left, True), np.setdiff1d(respaced, left, True)
        back = len(np.intersect1d(taken, put, True))
        out.append({"taken": len(taken), "back": back, "elsewhere": len(put) - back})
    return pa.array(out, pa.struct([(f.name, pa.int64()) for f in GAPS]))
