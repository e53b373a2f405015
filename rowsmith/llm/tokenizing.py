"""Encoding with a public byte-level BPE vocabulary, by the tokenizers library.

Ids are the library's for encode(text, add_special_tokens=False) without truncation or padding.  A space
after a sign that is no white space always begins a pre-token of such vocabularies, whatever stands around
it, so texts are cut there and the library encodes every distinct piece once; a worker remembers the short
ones.  Texts with the string of a special token go to the library whole.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the public pre-tokenizer pattern of this family of vocabularies.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_signs() -> dict[int, str]:
    """The printable sign of each byte in such vocabularies: itself where printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def require_byte_level(j: dict) -> None:
    """Refuse a vocabulary file that does not split texts by PRETOKEN, as all that is built on its boundaries would be wrong."""
    pre = j.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or j.get("normalizer") or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in j.get("added_tokens", [])):
        raise ValueError("not a plain byte-level vocabulary: its normalizer, pre-tokenizer or added tokens change texts")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """Ids by token bytes, merges in order, and the special tokens of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    require_byte_level(j)
    byte_of = {s: b for b, s in byte_signs().items()}
    special = {t["content"]: t["id"] for t in j["added_tokens"]}
    as_bytes = lambda s: bytes(map(byte_of.__getitem__, s))
    ids = {as_bytes(t): i for t, i in j["model"]["vocab"].items() if t not in special}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"])
    return ids, [(as_bytes(a), as_bytes(b)) for a, b in pairs], special


#: White space before a space, where the space is no certain boundary; and what a piece must not end in, nor be, to stand among others.
WHITE = "[" + "".join(rf"\x{{{c:X}}}" for c in range(0x3001) if chr(c).isspace()) + "]"
UNSURE, OPEN_END = f"{WHITE} ", f"(^|{WHITE})$"
#: Pieces that a worker remembers, the longest of them in bytes, and characters of new ones that are encoded as one text.
MEMORY, LONGEST, AT_ONCE = 1_000_000, 64, 1 << 18
NONE = np.zeros(0, "<u4")


class Pieces:
    """Ids of distinct strings: those of string k are flat[start[k] : start[k] + size[k]]."""

    def __init__(self):
        self.strings, self.start, self.size, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), NONE

    def add(self, strings: pa.Array, start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        self.start, self.size = np.concatenate([self.start, len(self.flat) + start]), np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])
        self.strings = pa.concat_arrays([self.strings, strings])


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        ids, _, special = vocabulary(path)
        self.special = list(special)
        self.sizes = np.zeros(self.vocab_size, np.int64)  # bytes of each token
        for token, i in [*ids.items(), *((t.encode(), i) for t, i in special.items())]:
            self.sizes[i] = len(token)
        self.memory = Pieces()

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each piece with a space before it, as start and size in all ids.

        Pieces that end in a sign are encoded as one text, whose ids are dealt out by their bytes.
        """
        words, length = wanted.to_pylist(), pc.binary_length(wanted).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        alone = pc.match_substring_regex(wanted, OPEN_END).to_numpy(zero_copy_only=False)
        start, size, flat, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [NONE], 0
        sure, rest = np.flatnonzero(~alone), np.flatnonzero(alone)
        for part in np.split(sure, np.flatnonzero(np.diff(np.cumsum(length[sure]) // AT_ONCE)) + 1):
            if not len(part):
                continue
            ids = self._each([" " + " ".join([words[k] for k in part])])[0]
            ends, wanted_ends = np.cumsum(self.sizes[ids]), np.cumsum(length[part])
            hi = np.searchsorted(ends, wanted_ends) + 1
            if not np.array_equal(ends[hi - 1], wanted_ends):
                raise ValueError("a token crosses a boundary that was taken as certain")
            size[part] = np.diff(hi, prepend=0)
            start[part] = total + hi - size[part]
            flat.append(ids)
            total += len(ids)
        for k, ids in zip(rest, self._each([" " + words[k] for k in rest])):
            start[k], size[k] = total, len(ids)
            flat.append(ids)
            total += len(ids)
        return start, size, np.concatenate(flat)

    def ids(self, text: str | None) -> list[int]:
        return self.encode([text])[0].tolist()

    def encode(self, batch: list[str | None], end: int | None = None) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text, with `end` after them if given."""
        out: list[np.ndarray] = [NONE] * len(batch)
        some = [k for k, t in enumerate(batch) if t]
        unsure = pc.match_substring_regex(pa.array([batch[k] for k in some], pa.large_string()), UNSURE).to_pylist()
        odd = [k for k, u in zip(some, unsure) if u or any(s in batch[k] for s in self.special)]
        sure = [k for k in some if k not in set(odd)] if odd else some
        for k, ids in zip(odd, self._each([batch[k] for k in odd])):
            out[k] = ids
        if sure:
            for k, ids in zip(sure, self._cut([batch[k] for k in sure])):
                out[k] = ids
        tail = NONE if end is None else np.array([end], dtype="<u4")
        return [np.concatenate([ids, tail]) for ids in out] if len(tail) else out

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts cut before every space, each of which follows a sign."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()).cast(pa.string()), " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if len(self.memory.strings) > MEMORY:
            self.memory = Pieces()
        at = pc.index_in(words, value_set=self.memory.strings)
        missing = pc.is_null(at)
        new, base = words.filter(missing), self.memory
        start1, n, more = self.pieces(new)
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        start, size, flat = base.start, base.size, base.flat
        place, m = np.empty(len(words), np.int64), missing.to_numpy(zero_copy_only=False)
        place[~m] = at.drop_null().to_numpy()
        place[m] = len(start) + np.arange(len(new))
        firsts = self._each([t.partition(" ")[0] for t in texts])  # no space before them
        n1 = np.array([len(x) for x in firsts], np.int64)
        start = np.concatenate([start, len(flat) + start1, len(flat) + len(more) + np.cumsum(n1) - n1])
        size = np.concatenate([size, n, n1])
        flat = np.concatenate([flat, more, *firsts])
        code = place[code]
        code[offsets[:-1]] = len(start) - len(firsts) + np.arange(len(firsts))
        each = size[code]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(start[code] - ends[:-1], each) + np.arange(ends[-1])]
        keep = short.to_numpy(zero_copy_only=False)
        base.add(new.filter(short), start1[keep], n[keep], more)
        return np.split(ids, ends[offsets[1:-1]])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
