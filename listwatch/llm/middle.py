"""Fill-in-the-middle transformation, with both cuts found in a wavelet matrix over character classes.

A text is a sequence of units: a run of ASCII letters, or one other code point.  Every byte of its UTF-8
form has one of four classes: the rest of a code point, a letter after a letter, a letter that begins a
run, another code point's first byte.  A wavelet matrix over the classes answers how many bytes of a
class stand before a place.  Units that begin before a place are the ranks of the two beginning
classes together, code points all bytes but those of the first class; a cut after a number of units is
found by bisection on these ranks.  One matrix serves all texts of a batch, and all its queries are
vectorised over the texts.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

REST, LETTER, RUN, OTHER = range(4)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[0x80:0xC0] = REST
CLASSES[ord("A"): ord("Z") + 1] = CLASSES[ord("a"): ord("z") + 1] = RUN

#: Bytes of text that one matrix covers, unless a single text is longer.
MATRIX_BYTES = 1 << 22


class WaveletMatrix:
    """Ranks over a sequence of symbols below ``2 ** bits``.

    A level is the vector of one bit of every symbol, highest bit first; on the way to the next
    level the zeros go before the ones.  A bit vector is kept in words of 64 with the ones before each.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for shift in reversed(range(bits)):
            bit = (symbols >> shift & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.levels.append((shift, words, before, len(bit) - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each of the places ``at``."""
        start, at = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for shift, words, before, zeros in self.levels:
            low, high = self._ones(words, before, start), self._ones(words, before, at)
            start, at = (zeros + low, zeros + high) if symbol >> shift & 1 else (start - low, at - high)
        return at - start


class Boundaries:
    """Unit and code point counts in the texts ``data[starts[i]:ends[i]]`` that follow one another."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        classes = CLASSES[data]
        letter = classes == RUN
        inner = np.zeros(len(data), bool)
        inner[1:] = letter[1:] & letter[:-1]
        inner[self.starts[self.starts < len(data)]] = False
        classes[inner] = LETTER
        self.matrix = WaveletMatrix(classes, 2)
        self.units = self._begun(self.ends) - self._begun(self.starts)

    def _begun(self, at: np.ndarray) -> np.ndarray:
        return self.matrix.rank(RUN, at) + self.matrix.rank(OTHER, at)

    def points(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code points between places."""
        return end - start - (self.matrix.rank(REST, end) - self.matrix.rank(REST, start))

    def after(self, units: np.ndarray) -> np.ndarray:
        """Place behind the first ``units`` units of each text: where the next one begins, else the text's end."""
        wanted = self._begun(self.starts) + units
        low, high = self.starts.copy(), self.ends.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            beyond = self._begun(np.minimum(middle + 1, self.ends)) > wanted
            high = np.where(open_ & beyond, middle, high)
            low = np.where(open_ & ~beyond, middle + 1, low)
        return low


@dataclass(frozen=True)
class FillInMiddle:
    """Turns texts into prefix, suffix and middle in the order that their hash picks.

    ``plain_percent`` of the texts stay as they are, and so do empty texts and those that contain a
    sentinel; of the others ``spm_percent`` have the suffix first.  The four numbers behind a row's
    choices are the first words of sha256("seed:id"), so equal ids are cut alike on every run.

    Null texts count as empty, a null id as an empty one.  Repeated rows are transformed repeatedly.
    Other columns are ignored, whatever their names.
    """

    seed: int = 1
    plain_percent: int = 10
    spm_percent: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    id: str = "doc_id"
    text: str = "text"

    def transform(self, docs: DataFrame) -> DataFrame:
        """id, n (units), form, prefix_chars, middle_chars (null if plain) and output per row."""
        rows = docs.select(F.col(self.id).alias("id"), F.coalesce(F.col(self.text), F.lit("")).alias("text"))
        kind = rows.schema["id"].dataType.simpleString()
        found = rows.mapInArrow(
            self._batches, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
        return found.withColumnRenamed("id", self.id)

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        overlap = lambda x, y: any(x[k:] == y[: len(x) - k] for k in range(1, len(x)))
        inside = any(marks[i] in marks[j] for i in range(3) for j in range(3) if i != j)
        if inside or any(overlap(x, y) for x in marks for y in marks):
            raise ValueError(f"sentinels must not overlap: {marks}")

    def restored(self, output: Column, form: Column) -> Column:
        """The text again, from an output and its form: sentinels occur once, and only where they were put."""
        part = lambda text, mark, k: F.split_part(text, F.lit(mark), F.lit(k))

        def joined(first: str, second: str, order: tuple[int, int, int]) -> Column:
            rest = part(output, second, 2)
            parts = (F.substring(part(output, second, 1), len(first) + 1, 1 << 30), part(rest, self.middle, 1), part(rest, self.middle, 2))
            return F.concat(*[parts[i] for i in order])

        return (F.when(form == "psm", joined(self.prefix, self.suffix, (0, 2, 1)))
                .when(form == "spm", joined(self.suffix, self.prefix, (1, 2, 0))).otherwise(output))

    def _batches(self, batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + MATRIX_BYTES, "right")) - 1)
                yield self._cut(batch.column(0).slice(first, last - first), data[offsets[first]: offsets[last]],
                                offsets[first: last + 1] - offsets[first])
                first = last

    def _cut(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        bounds = Boundaries(data, offsets)
        digests = [hashlib.sha256(f"{self.seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids.to_pylist()]
        h = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)
        cuts = h[:, :2] % (bounds.units[:, None] + 1)
        one, two = bounds.after(cuts.min(axis=1)), bounds.after(cuts.max(axis=1))
        before, between = bounds.points(bounds.starts, one), bounds.points(one, two)
        p, s, m = (x.encode() for x in (self.prefix, self.suffix, self.middle))
        forms, outputs, raw = [], [], data.tobytes()
        for i, (start, a, b, end) in enumerate(zip(bounds.starts, one, two, bounds.ends)):
            text = raw[start:end]
            if not text or p in text or s in text or m in text or h[i, 2] % 100 >= 100 - self.plain_percent:
                forms.append("plain")
                outputs.append(text)
            elif h[i, 3] % 100 < self.spm_percent:
                forms.append("spm")
                outputs.append(b"".join((s, raw[b:end], p, raw[start:a], m, raw[a:b])))
            else:
                forms.append("psm")
                outputs.append(b"".join((p, raw[start:a], s, raw[b:end], m, raw[a:b])))
        plain = np.array([f == "plain" for f in forms])
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(bounds.units, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64(), mask=plain),
             pa.array(between, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())],
            ["id", "n", "form", "prefix_chars", "middle_chars", "output"])
