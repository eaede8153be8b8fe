"""Language identification by bit-sliced Bloom filters over n-grams.

Every filter position holds one bit for each language.  The conjunction of an n-gram's positions is the set of all
languages that contain it, found by one lookup for all of them.  Per-language popcounts over a text, corrected for
each filter's false positives, decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import chunks, extended, materialise, pack, strings

UNKNOWN = "und"
#: Odd multipliers of the filter's hash functions.  Fixed values of this format.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def letters_table() -> np.ndarray:
    """Bytes of letters as themselves, A-Z in lower case, all others as a space; bytes of longer characters are letters."""
    table = np.full(256, 32, dtype=np.uint8)
    table[128:] = np.arange(128, 256)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


LETTERS = letters_table()


def has_letter(text: bytes) -> bool:
    raw = np.frombuffer(text, dtype=np.uint8)
    if ((raw | 32) - 97 < 26).any():
        return True
    return bool((raw > 127).any()) and any(c.isalpha() for c in text.decode())


def grams(texts: list[bytes], n: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (n bytes packed into an integer) of all texts, and the index of each one's text.

    Texts are lower-cased, runs of other characters become one space, and a space stands at both ends.
    """
    lowered = [t.decode().lower().encode() if not t.isascii() else t for t in texts]
    buffer, starts, ends = pack([b" " + t + b" " for t in lowered])
    mapped = LETTERS[buffer]
    space = mapped == 32
    keep = ~(space & np.append(False, space[:-1]))
    keep[starts] = True
    owner = np.zeros(len(buffer), dtype=np.int32)
    owner[starts[1:]] = 1
    owner = np.cumsum(owner, dtype=np.int32)
    flat, owner = mapped[keep].astype(np.uint32), owner[keep]
    if len(flat) < n:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int32)
    size = len(flat) - n + 1
    value = np.zeros(size, dtype=np.uint32)
    for i in range(n):
        value = value << np.uint32(8) | flat[i : i + size]
    inside = owner[:size] == owner[n - 1 :]
    return value[inside], owner[:size][inside]


@dataclass
class Filters:
    """Bloom filters of all languages, bit-sliced: ``table[position]`` has one bit per slot, eight to a byte.

    A language has a slot for each level, from the filter of all its n-grams to narrower ones.
    """

    languages: list[str]
    common: str
    table: np.ndarray
    false_rate: np.ndarray
    levels: int = 1

    @classmethod
    def of_bits(cls, languages: list[str], common: str, log2_positions: int, owner: np.ndarray, word: np.ndarray, bits: np.ndarray, levels: int = 1) -> Filters:
        """From the filters' set bits: 64 positions a word, each word with the number of its slot."""
        slots = len(languages) * levels
        table = np.zeros((1 << log2_positions, max(1, -(-slots // 8))), dtype=np.uint8)
        fill = np.zeros(slots)
        for i in range(slots):
            own = owner == i
            set_ = np.unpackbits(np.ascontiguousarray(bits[own].astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            at = (word[own][:, None] * 64 + np.arange(64))[set_]
            table[at, i // 8] |= np.uint8(1 << i % 8)
            fill[i] = len(at) / len(table)
        return cls(languages, common, table, fill ** len(MIX), levels)

    @staticmethod
    def positions(values: np.ndarray, log2_positions: int) -> list[np.ndarray]:
        spread = values * np.uint64(0xD6E8FEB86659FD93)
        spread ^= spread >> np.uint64(32)
        return [(spread * np.uint64(m)) >> np.uint64(64 - log2_positions) for m in MIX]

    def languages_of(self, values: np.ndarray) -> np.ndarray:
        """For each n-gram the bytes whose set bits are the slots of the languages that contain it."""
        found = None
        for at in self.positions(values.astype(np.uint64), int(self.table.shape[0]).bit_length() - 1):
            found = self.table[at] if found is None else found & self.table[at]
        return found

    def decide(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """Language and score of each text: the share of the corrected popcounts, over all levels, that the best language has."""
        out: list[tuple[str, float]] = []
        for start, end in chunks(texts, 1 << 20):
            part = texts[start:end]
            values, owner = grams(part)
            hits = np.zeros((len(part), len(self.false_rate)))
            if len(values) and self.languages:
                found = self.languages_of(values)
                for i in range(len(self.false_rate)):
                    bit = found[:, i // 8] & np.uint8(1 << i % 8) > 0
                    hits[:, i] = np.bincount(owner[bit], minlength=len(part))
            count = np.bincount(owner, minlength=len(part))[:, None]
            # a full filter tells nothing: its share is 0
            share = np.maximum(0.0, (hits / np.maximum(count, 1) - self.false_rate) / np.where(self.false_rate < 1, 1 - self.false_rate, np.inf))
            share = share.reshape(len(part), -1, self.levels).sum(axis=2)
            total = share.sum(axis=1)
            for i, text in enumerate(part):
                if not self.languages or not has_letter(text):
                    out.append((UNKNOWN, 0.0))
                elif total[i] <= 0:
                    out.append((self.common, 0.0))
                else:
                    best = int(share[i].argmax())
                    out.append((self.languages[best], float(share[i, best] / total[i])))
        return out


def gram_counts(labelled: DataFrame, lang: str, text: str) -> DataFrame:
    """``lang, gram, n`` over all rows: numpy counts inside each task, then a combined sum."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for language, parts in held.items():
                values, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])
            held.clear()

        def merged(parts):
            values, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return values, np.bincount(place, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            languages, texts = batch.column(0).to_pylist(), strings(batch.column(1))
            for language in sorted(set(languages)):
                own = [t for t, x in zip(texts, languages, strict=True) if x == language]
                for start, end in chunks(own, 1 << 20):
                    values, counts = np.unique(grams(own[start:end])[0], return_counts=True)
                    parts = held.setdefault(language, [])
                    parts.append((values, counts))
                    size += len(values)
                    if len(parts) > 16:
                        held[language] = [merged(parts)]
            if size > 1 << 22:
                yield from flush()
                size = 0
        yield from flush()

    counts = labelled.select(lang, text).mapInArrow(run, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def filter_bits(members: DataFrame, log2_positions: int) -> DataFrame:
    """``lang, word, bits`` of the filters of ``lang, gram``: positions become words of 64 bits in the tasks, or-ed map-side."""

    def run(batches):
        for batch in batches:
            grams_ = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            names = batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            for i, name in enumerate(names.dictionary.to_pylist()):
                at = np.unique(np.concatenate(Filters.positions(grams_[codes == i], log2_positions)))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(word), pa.string()), pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["lang", "word", "bits"])

    return members.select("lang", "gram").mapInArrow(run, "lang string, word long, bits long").groupBy("lang", "word").agg(F.bit_or("bits").alias("bits"))


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", levels: tuple[float, ...] = (0.0, 0.25), most_log2: int = 28) -> Filters:
    """Filters from every n-gram of every labelled row with a language.

    Each language has a filter a level.  That of level 0 holds every n-gram of the language, however rare; a higher one
    those whose share of the language's text is ``level`` or more of the largest share that any language gives them.
    In a large corpus stray foreign lines put most n-grams into all filters of level 0; the popcounts of the narrower
    ones then tell languages apart, and those of level 0 decide where these are equal.  Filters have 16 positions for
    each n-gram of the largest, from 2**16 to 2**``most_log2`` (n-grams are four bytes, so their number is bounded);
    that bounds what is gathered and broadcast, a byte a position for eight filters.  Fuller filters have a larger
    false-positive rate, which the decision corrects; no n-gram is left out.
    """
    counts = materialise(gram_counts(labelled.filter(F.col(lang).isNotNull()), lang, text))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    by_gram = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("all"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(float(x)).alias("least")) for k, x in enumerate(levels)]))
    of_level = by_gram.select("gram", "top", F.inline("all")).select("*", each.alias("level")).filter(F.col("share") >= F.col("level.least") * F.col("top"))
    members = materialise(of_level.select(F.concat(F.col("level.slot").cast("string"), F.lit(":"), F.col("lang")).alias("lang"), "gram"))
    sizes = totals.orderBy(F.col("total").desc(), "lang").toPandas()
    most = members.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    log2_positions = min(max(16, (16 * most - 1).bit_length()), most_log2)
    found = filter_bits(members, log2_positions).toPandas()
    languages = sorted(sizes["lang"])
    slot = {f"{k}:{x}": i * len(levels) + k for i, x in enumerate(languages) for k in range(len(levels))}
    owner, word, bits = found["lang"].map(slot), found["word"], found["bits"]
    common = sizes["lang"].iloc[0] if len(sizes) else UNKNOWN
    return Filters.of_bits(languages, common, log2_positions, *[x.to_numpy(dtype=np.int64) for x in (owner, word, bits)], levels=len(levels))


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``.  ``und`` with score 0 for a null text or one without a letter.

    A text with letters of which no n-gram is known gets the language with the most training text, score 0.  Equal
    popcounts go to the first language by name.  Columns of ``docs`` with those names are replaced.
    """
    kept = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    schema = extended(kept, lang_pred="string", score="double")
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        own = shared.value
        for batch in batches:
            found = own.decide(strings(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``part``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part
