"""Token ids of whole texts by the ``tokenizers`` library.

A byte-level tokenizer cuts every text before a run of white space that follows
other characters, whatever else the text holds. So the ids of a text are the ids
of its chunks (white space, then a word) one after the other, and each distinct
chunk of a batch has to be encoded once only. Words of plain Latin letters with
closing punctuation go straight to the library's model, since their pre-tokens
are known; all other chunks take the library's full path. Tokenizers of another
make encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa

#: White space, Latin letters without an apostrophe near them, closing ASCII punctuation.
PLAIN = re.compile(r"([ \t-\r]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Texts are worked on in slices of about so many bytes.
SLICE_BYTES = 4 << 20
#: Chunks that each of the two generations of the cache may hold (some 200 bytes each).
CACHED = 350_000


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls."""
    a = texts.cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64, count=len(a) + 1 + a.offset)[a.offset :]
    data = a.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES):
    """Row ranges of about ``size`` bytes, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


class TextTokenizer:
    """ids(texts): the ids of each text, as the library gives them without special tokens added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.model = self.tk.model
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre, norm = kind.get("pre_tokenizer") or {}, kind.get("normalizer")
        steps = pre.get("pretokenizers", [])
        added = all(not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in kind.get("added_tokens", []))
        bpe = kind["model"]["type"] == "BPE" and not kind["model"].get("dropout") and added
        #: "spaced": a blank belongs to the next word; "words": white space is dropped, A-Z lower-cased.
        self.mode = "whole"
        if bpe and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.mode = "spaced"
        elif bpe and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"] and "[\\p{L}]+" in steps[0]["pattern"].get("Regex", "") and "Lowercase" in [x["type"] for x in norm.get("normalizers", [])]:
            self.mode = "words"
        self.letters = byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @property
    def size(self) -> int:
        return self.tk.get_vocab_size()

    def _piece(self, s: str) -> bytes:
        """Ids of one pre-token, as little-endian unsigned 32-bit integers."""
        if not s.isascii() or s[0] <= " ":
            s = s.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(s)]).tobytes()

    def _chunks(self, values: list[str]) -> list[bytes]:
        """The ids of each chunk, as little-endian unsigned 32-bit integers."""
        if len(self.young) >= CACHED:
            self.old, self.young = self.young, {}
        young, old, piece, plain = self.young, self.old, self._piece, PLAIN.fullmatch
        words = self.mode == "words"
        out = [young.get(v) for v in values]
        hard = []
        for i in [i for i, x in enumerate(out) if x is None]:
            v = values[i]
            if (got := old.get(v)) is not None:
                young[v] = out[i] = got
                continue
            m = plain(v)
            if m is None or not words and m[1] not in ("", " ", "\n"):
                hard.append(i)
                continue
            core, tail = m[2].lower() if words else m[1] + m[2], m[3]
            if (got := young.get(core)) is None and (got := old.get(core)) is None:
                got = piece("\n") + piece(m[2]) if core[0] == "\n" else piece(core)
            young[core] = got
            if tail:
                if (end := young.get("\0" + tail)) is None:
                    young["\0" + tail] = end = piece(tail)
                got += end
            if v is not core:
                young[v] = got
            out[i] = got
        if hard:
            for i, e in zip(hard, self.tk.encode_batch_fast([values[i] for i in hard], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
                if len(values[i]) < 64:
                    young[values[i]] = out[i]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); nulls count as empty."""
        texts = texts.fill_null("")
        if self.mode == "whole":
            got = [np.array(e.ids, dtype=np.uint32) for e in self.tk.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(x) for x in got], dtype=np.int64)
        data, offsets = text_buffers(texts)
        counts = np.zeros(len(texts), dtype=np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), counts
        space = SPACE[data]
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = space[1:] & ~space[:-1]
        # where white space counts, no cut after such beyond ASCII: U+0085, U+00A0 and the three-byte ones
        at = np.flatnonzero(cut) if self.mode == "spaced" else np.zeros(0, np.int64)
        wide = at[(data[at - 1] >= 0x80) & (at >= 2)]
        cut[wide[(data[wide - 2] == 0xC2) & ((data[wide - 1] == 0x85) | (data[wide - 1] == 0xA0))]] = False
        wide = wide[wide >= 3]
        cut[wide[(data[wide - 3] >= 0xE1) & (data[wide - 3] <= 0xE3)]] = False
        full = offsets[:-1][np.diff(offsets) > 0]
        cut[full] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data))
        if self.mode == "words":  # white space is dropped anyway
            kept = ~space
            bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
            data = data[kept]
        chunks = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        parts = self._chunks(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), dtype="<u4")
        firsts = np.cumsum(lengths) - lengths
        code = coded.indices.to_numpy()
        each = lengths[code]
        out = flat[ragged(firsts[code], each)]
        # chunk range of each text
        upto = np.concatenate([[0], np.cumsum(each)])
        counts[:] = np.diff(upto[np.searchsorted(starts, offsets)])
        return out, counts

    def batches(self, batch: pa.RecordBatch, column: str = "text"):
        """(first row, ids, counts) of slices of a batch."""
        col = batch.column(batch.schema.get_field_index(column)).fill_null("")
        _, offsets = text_buffers(col)
        for a, b in slices(offsets):
            yield (a, *self.ids(col.slice(a, b - a)))


@cache
def tokenizer(path: str) -> TextTokenizer:
    """One tokenizer, and one cache, for each Python worker."""
    return TextTokenizer(path)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine; called where it is read."""
    import public_tokenizers

    return public_tokenizers.path(name)
