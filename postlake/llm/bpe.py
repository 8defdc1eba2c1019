"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 characters cuts each text into chunks whose borders
depend on content alone, so passages that documents share give the same chunks
wherever they stand. A task encodes each distinct chunk once and keeps it in a
cache bounded by ``cache_chars``; no text is shuffled.

A border may fall inside a word. Every chunk join is repaired: the stretch from
the last safe place before the join to the first after it is encoded anew, and
the chunks keep only what lies outside. A safe place has a visible character
before it and ASCII white space after it: no match of the pre-tokenizer's
pattern, and no added token, crosses one. The repair is accepted when its ends
fall on token borders of the chunks they stand in; otherwise that end moves on to the
next safe place, over whole chunks if need be, at last to the end of the text.

Defined cases: a null text counts as empty and has no tokens; a long text is encoded
whole; repeated rows each give theirs; every row gives one row; an empty table gives an empty result;
columns of any other name are left out.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, light, pick, text_batches

WINDOW_DOUBLINGS = 4  # a window of 2 ** 4 characters
SLICE_CHARS = 500_000

# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond these letters the character classes of two libraries may differ by Unicode version.
BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")
LONG_CHUNK = 8192


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_table(tokenizer) -> list[bytes]:
    """The bytes of each id, by the byte-level alphabet: printable Latin-1 stands for itself, the rest for 256 onwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    return [special[i].encode() if i in special else bytes(byte[c] for c in tokenizer.id_to_token(i)) for i in range(size)]


class ChunkEncoder:
    def __init__(self, path: str, chunk_chars: int = 512, least_chars: int = 64, cache_chars: int = 2_000_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bytes_of = byte_table(self.tokenizer)
        self.n_bytes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        ranks = {b: i for i, b in enumerate(self.bytes_of) if i not in special.values()}
        # the same vocabulary in a faster encoder, for chunks on which both are tested to agree
        self.latin = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.gear = np.random.default_rng(7).integers(0, 1 << 32, 1 << 12, dtype=np.uint32)
        self.mask = np.uint32(chunk_chars - 1)
        self.least, self.limit = least_chars, cache_chars
        self.cache: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0

    def cuts(self, points: np.ndarray) -> list[int]:
        """Borders of the chunks of one text, 0 and its length included."""
        n = len(points)
        h = self.gear[points & 0xFFF]
        for k in range(WINDOW_DOUBLINGS):
            step = 1 << k
            if n > step:
                h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        out = [0]
        for p in np.flatnonzero(((h >> np.uint32(16)) & self.mask) == 0).tolist():
            if p + 1 - out[-1] >= self.least and n - p - 1 >= self.least:
                out.append(p + 1)
        out.append(n)
        return out

    @staticmethod
    def safe_places(points: np.ndarray) -> np.ndarray:
        white = (points == 32) | (points == 10) | (points == 9) | (points == 13)
        seen = (points > 32) & (points != 0x85) & (points != 0xA0) & ((points < 0x1680) | (points > 0x3000))
        return np.flatnonzero(white[1:] & seen[:-1]) + 1

    def _learn(self, chunks) -> None:
        new = [c for c in dict.fromkeys(chunks) if c not in self.cache]
        odd = [c for c in new if len(c) > LONG_CHUNK or (not c.isascii() and BEYOND_LATIN.search(c))]
        known = dict(zip(odd, (e.ids for e in self.tokenizer.encode_batch(odd, add_special_tokens=False))))
        for c in new:
            ids = np.array(known[c] if c in known else self.latin.encode(c, allowed_special=self.special), dtype=np.uint32)
            self.cache[c] = ids, np.concatenate(([0], np.cumsum(self.n_bytes[ids])))
            self.held += len(c)

    def _measure(self, text: str):
        """(borders of chunks, safe places, byte offset of every character) of a text of several chunks; None for one."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        cuts = self.cuts(points)
        if len(cuts) == 2:
            return None
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        return cuts, self.safe_places(points), np.concatenate(([0], np.cumsum(width, dtype=np.int64)))

    def _agrees(self, text: str, cuts: list[int], at: np.ndarray, place: int) -> bool:
        """Whether place is a token border of the chunk it stands in, or an end of the text."""
        if place in (0, len(text)):
            return True
        k = bisect.bisect_right(cuts, place) - 1
        ends = self.cache[text[cuts[k] : cuts[k + 1]]][1]
        offset = at[place] - at[cuts[k]]
        i = int(np.searchsorted(ends, offset))
        return i < len(ends) and ends[i] == offset

    def _pieces(self, text: str, measured) -> list[tuple[str, int | None, int | None]]:
        """(chunk, from, to) with the bytes of a cached chunk to keep, and (stretch, None, None) to encode anew, in order."""
        if measured is None:
            return [(text, None, None)] if text else []
        cuts, safe, at = measured
        places = [0, *safe.tolist(), len(text)]
        stretches: list[list[int]] = []
        for join in cuts[1:-1]:
            if stretches and join < stretches[-1][1]:
                continue
            low, high = bisect.bisect_right(places, join) - 1, bisect.bisect_left(places, join)
            while not self._agrees(text, cuts, at, places[low]):
                low -= 1
            while not self._agrees(text, cuts, at, places[high]):
                high += 1
            start, stop = places[low], places[high]
            while stretches and stretches[-1][1] > start:  # it grew into the one before
                start = min(start, stretches.pop()[0])
            if start < stop:
                stretches.append([start, stop])
        pieces, done = [], 0
        for start, stop in [*stretches, [len(text), len(text)]]:
            while done < start:  # what chunks keep up to the stretch
                k = bisect.bisect_right(cuts, done) - 1
                end = min(start, cuts[k + 1])
                pieces.append((text[cuts[k] : cuts[k + 1]], int(at[done] - at[cuts[k]]), int(at[end] - at[cuts[k]])))
                done = end
            if start < stop:
                pieces.append((text[start:stop], None, None))
            done = max(done, stop)
        return pieces

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        measured = [self._measure(t) if t else None for t in texts]
        if self.held > self.limit:
            self.cache.clear()
            self.held = 0
        self._learn(t[a:b] for t, m in zip(texts, measured) if m for a, b in zip(m[0], m[0][1:]))
        plans = [self._pieces(t, m) for t, m in zip(texts, measured)]
        self._learn(c for plan in plans for c, start, _ in plan if start is None)
        out = []
        for plan in plans:
            parts = []
            for chunk, start, stop in plan:
                ids, ends = self.cache[chunk]
                parts.append(ids if start is None else ids[slice(*np.searchsorted(ends, (start, stop)).tolist())])
            out.append(np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids_sha256, decoded_sha256, and with_ids ids (array<int>) and decoded.

    path: the tokenizer's file, at the same place on every machine.
    """
    path = path or tokenizer_path()
    narrow = text_batches(pick(docs, id_col, text_col).toDF("id", "text"))
    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches):
        encoder = ChunkEncoder(path)
        for batch in light(batches):
            ids_col, texts = batch.column(0), batch.column(1)
            start = 0
            while start < len(texts):
                part, size = [], 0
                while start + len(part) < len(texts) and size < SLICE_CHARS:
                    part.append(texts[start + len(part)].as_py() or "")
                    size += len(part[-1])
                tokens = encoder.encode(part)
                decoded = [encoder.decode(t) for t in tokens]
                columns = [
                    ids_col.slice(start, len(part)), pa.array([len(t) for t in tokens], pa.int64()),
                    pa.array([hashlib.sha256(t.astype("<u4").tobytes()).hexdigest() for t in tokens]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([t.astype(np.int32) for t in tokens], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                start += len(part)
        encoder = None
        give_back()

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_ids=False)
