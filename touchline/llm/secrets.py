"""Secrets in text: fixed patterns, and random strings told from ordinary ones by character Markov models.

Models of the next character given the one before are learned from labelled samples: of random strings, from
the values that the fixed patterns find in the corpus and from generated keys; of ordinary strings, from all
that the patterns leave of the corpus, and from identifiers, paths and dates made of common words. A long
token is a secret if its likelihood as a random string, over that as either ordinary kind, exceeds the odds
against a token being one.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_chunks, texts_of

#: Base patterns, their order and least lengths (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Natural logarithm of the odds against a token being random.
ODDS = 20.0
#: Characters that the models know, and one for all others.
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
STATES = len(ALPHABET) + 1
#: Generated keys that the model of random strings begins with.
GENERATED = 2000

_STATE = np.full(256, len(ALPHABET), dtype=np.int64)
for _i, _c in enumerate(ALPHABET):
    _STATE[ord(_c)] = _i
_RUN = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The spans (kind, start, end) of the fixed patterns, in code points, by start and then kind."""
    found: list[Span] = []
    octets = text.encode("utf-8", "surrogatepass")
    lowered = octets.lower()
    if any(w in lowered for w in _WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in octets:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if b"h" * LEAST["hex"] in octets.translate(_RUN):
        found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def without(text: str, spans: list[Span], filler: str) -> str:
    """text with filler for each stretch that spans cover."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            out += [text[at:start], filler]
        at = max(at, end)
    return "".join(out) + text[at:]


def _pairs(octets: bytes) -> np.ndarray:
    states = _STATE[np.frombuffer(octets, dtype=np.uint8)]
    return np.bincount(states[:-1] * STATES + states[1:], minlength=STATES**2) if len(states) > 1 else np.zeros(STATES**2, np.int64)


def generated(n: int = GENERATED, seed: int = 1) -> list[str]:
    """Random strings as keys are: letters and digits, base 64, hexadecimal."""
    r = random.Random(seed)
    sets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef", string.ascii_uppercase + string.digits)
    return ["".join(r.choice(sets[k % len(sets)]) for _ in range(r.randint(20, 48))) for k in range(n)]


_PARTS = """account address all amount array backup base batch buffer byte cache call catalog child class client close code column config connection
content context count create current customer data database date default delete description element end entity error event example expression factory file
filter first for format from function get group handler hash header history id image in index info input instance int internal is item java key label last
length level line link list load local log main manager map message method model module name new node not null number object of offset on open option order
org output page parameter parent parse path plan point position private process product project property provider public query read record reference
registry remote report repository request reset resource response result row run schema search select send server service session set size source spark
sql start state status string system table task test text time to token total type update url user value version view visit web write"""


def ordinary(n: int = GENERATED, seed: int = 2) -> list[str]:
    """Identifiers, paths and dates as code and configuration have them."""
    r, parts = random.Random(seed), _PARTS.split()
    joins = (
        lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), lambda w: "".join(x.capitalize() for x in w), "_".join, lambda w: "_".join(w).upper(), "-".join, "/".join,
        lambda w: "/".join(w[:2]) + "/" + "".join(x.capitalize() for x in w[2:]), lambda w: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}-" + "-".join(w[:2]), lambda w: "_".join(w) + str(r.randint(1, 99)),
    )
    out = [r.choice(joins)([r.choice(parts) for _ in range(r.randint(3, 6))]) for _ in range(2 * n)]
    return out + [c * 24 for c in ALPHABET] * 8


@dataclass
class Models:
    """ratios: for each ordinary kind the log-likelihood ratio of each pair of characters, random over ordinary."""

    ratios: np.ndarray

    def score(self, token: str) -> float:
        states = _STATE[np.frombuffer(token.encode("ascii"), dtype=np.uint8)]
        return float(self.ratios[:, states[:-1], states[1:]].sum(axis=1).min())

    def spans(self, text: str) -> list[Span]:
        """The base spans and the random tokens that overlap none of them, by start and then kind."""
        found = base_spans(text)
        base = list(found)
        for m in TOKEN.finditer(text):
            if any(s < m.end() and m.start() < e for _, s, e in base):
                continue
            if self.score(m[0]) > ODDS:
                found.append(("random", *m.span()))
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def train(docs: DataFrame, text_col: str = "text") -> Models:
    """The two models, from pairs of characters counted over all rows. Counts are summed by Spark; the driver
    gets one row for each pair. With no rows, the generated keys are told from even odds."""

    def run(batches):
        counts = np.zeros((2, STATES**2), np.int64)
        for batch in in_chunks(batches, 0):
            plain, secret = [], []
            for octets in texts_of(batch.column(0)):
                text = octets.decode("utf-8", "replace")
                spans = base_spans(text)
                plain.append(without(text, spans, " ").encode() if spans else octets)
                secret += [text[s:e] for kind, s, e in spans if kind != "assign"]
            counts[0] += _pairs(b" ".join(plain))
            counts[1] += sum((_pairs(s.encode()) for s in secret), np.zeros(STATES**2, np.int64))
        kind, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(pair), pa.array(counts[kind, pair])], ["kind", "pair", "n"])

    counts = np.zeros((2, STATES**2))
    summed = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "kind bigint, pair bigint, n bigint").groupBy("kind", "pair").agg(F.sum("n").alias("n"))
    for r in summed.collect():
        counts[r["kind"], r["pair"]] = r["n"]
    return models(counts)


def models(counts: np.ndarray) -> Models:
    """The models of pairs counted in the corpus, ordinary and secret."""
    of = lambda strings: sum((_pairs(s.encode()) for s in strings), np.zeros(STATES**2, np.int64))
    own, secret = of(generated()), counts[1]
    if secret.sum() > own.sum():  # found values weigh as much as the generated keys, not more
        secret = secret * (own.sum() / secret.sum())
    tables = np.stack([counts[0], of(ordinary()), secret + own]).reshape(3, STATES, STATES) + 0.5
    logs = np.log(tables / tables.sum(axis=2, keepdims=True))
    return Models(logs[2] - logs[:2])


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row; a null text has none. Repeated rows and null ids get a row each; no rows give
    no rows; other columns are ignored."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in in_chunks(batches):
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in models.spans(t.decode("utf-8", "replace"))] for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["id", "spans"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, f"id bigint, spans {_SPANS}").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, models: Models, text_col: str = "text", length_col: str = "n_chars", filler: str = "[SECRET]") -> DataFrame:
    """docs with filler for each secret; the length column, if there is one, follows. No row is dropped."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in in_chunks(batches, at):
            out = []
            for text in batch.column(at).to_pylist():
                spans = models.spans(text) if text else []
                out.append(without(text, spans, filler) if spans else text)
            yield batch.set_column(at, batch.schema.names[at], pa.array(out, batch.schema.types[at]))

    done = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        done = done.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return done


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of each base kind, the digest of the base spans and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS[:3]]
    base = joined(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select(id_col, *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(scan(docs, train(docs)))
