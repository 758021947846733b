"""Language identification by compression with per-language zstandard dictionaries.

``fit`` gathers a bounded sample of text per language and uses all of it as one raw-content
dictionary.  A text is encoded, whole and in ``_CHUNK``-byte pieces, once per language; the
language with the smallest total wins.  Both sides are lower-cased first, and ASCII characters
other than letters become blanks.  Where the smallest totals tie, the text is encoded again at
the stronger level ``_STRONG``.  ``rejected`` marks narrow margins.

Defined cases: null texts and texts without a letter get ``und`` and score 0; without
learned languages every text gets ``und``; with one language its score is 1; remaining ties go
to the language with most rows to learn from, then to the lesser name; equal texts and
repeated rows get equal results; texts of any length are read whole, in bounded memory beside
the text itself.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import fold, held, small_batches, texts_in

_CHUNK = 1024
_FAST, _STRONG = 3, 12
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
UNDETERMINED = "und"


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def fit(docs: DataFrame, per_language: int = 160) -> dict[str, bytes]:
    """lang -> dictionary, most frequent language first.

    The fit sample is bounded: about ``per_language`` hashed rows of each language.  Their whole
    texts go into the dictionaries.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != 2))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(chance)
    grain = 1 << 30
    taken = known.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(grain)) < (chance * grain).cast("long"))
    rows = taken.select("lang", "text", F.xxhash64("doc_id").alias("h")).collect()
    pieces: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"])):
        pieces.setdefault(r["lang"], []).append(normalised(r["text"]))
    return {lang: b"\n".join(parts) for lang, parts in sorted(pieces.items(), key=lambda p: (-counts[p[0]], p[0]))}


class Encoders:
    """Digested dictionaries of one process, at both levels; the strong ones are made when a tie needs them."""

    def __init__(self, model: dict[str, bytes]):
        self.langs, self.model = list(model), model
        self.made: dict[int, list] = {}

    def sizes(self, data: bytes, level: int = _FAST) -> list[int]:
        """Total size of the encoded pieces for each language."""
        if level not in self.made:
            self.made[level] = [_encoder(d, level) for d in self.model.values()]
        chunks = [data[i : i + _CHUNK] for i in range(0, len(data), _CHUNK)]
        return [sum(len(e.compress(c)) for c in chunks) for e in self.made[level]]


def _encoder(data: bytes, level: int):
    params = zstandard.ZstdCompressionParameters.from_level(level, source_size=_CHUNK, dict_size=len(data), write_content_size=False, write_checksum=False, write_dict_id=False)
    content = zstandard.ZstdCompressionDict(data.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=params)


def detect(text: str | None, encoders: Encoders) -> tuple[str, float]:
    """(language, score); score is the runner-up's excess size over its own size."""
    if not text or not encoders.langs or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0
    data, langs = normalised(text), encoders.langs
    if len(langs) == 1:
        return langs[0], 1.0
    sizes = encoders.sizes(data)
    low = min(sizes)
    if sizes.count(low) > 1:
        sizes = [s if s > low else t - (1 << 40) for s, t in zip(sizes, encoders.sizes(data, _STRONG), strict=True)]
        best = min(range(len(langs)), key=lambda i: (sizes[i], i))
        return langs[best], 0.0
    best, second = sorted(range(len(langs)), key=lambda i: (sizes[i], i))[:2]
    return langs[best], min(1.0, (sizes[second] - sizes[best]) / max(sizes[second], 1))


def predict(text: Column, model) -> Column:
    """struct<lang, score> of each text; ``model`` is a broadcast of (a name of its own, what ``fit`` returned)."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        encoders = held(f"encoders {model.value[0]}", lambda: Encoders(model.value[1]))  # digesting takes longer than a batch
        found = [detect(t, encoders) for t in texts_in(texts)]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    return run(text)


def identify(docs: DataFrame, per_language: int = 160, narrow: float = 0.01) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs``."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, fit(docs, per_language)))
    found = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), predict(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), ((F.col("p.lang") == UNDETERMINED) | (F.col("p.score") < narrow)).alias("rejected"))
