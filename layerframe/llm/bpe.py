"""Byte-pair encoding through the tokenizers library with reuse of words and content-defined chunks.

`PieceEncoder` encodes space-separated pieces and keeps what it has encoded. It rests on two facts about a tokenizer
whose pre-tokenizer drops white space: no token crosses a space, and neither normalization nor pre-tokenization
looks across one. Tokenizers for which this does not hold get the library's own encoding of the whole text.

`ChunkEncoder` cuts texts where a rolling hash of the last WINDOW code points hits a mask. A chunk is looked up before anything
else is done with it; only chunks that are not known are encoded. The joins between chunks are then repaired: a window
around each join is encoded again and grows until its ids agree with the chunks' ids at both ends. Agreement proves the
whole sequence for the two kinds of tokenizers that it cuts:

- "words": white space is dropped and no token crosses it (see `spaced`); the window's ends lie at spaces.
- "pure": plain merges over the characters (see `pure`). A sequence is the encoding of its text exactly if every pair of
  neighbouring tokens is the encoding of its own text; all pairs lie inside a chunk's or a window's encoding.

All other tokenizers get whole texts from the library. Caches are bounded in bytes and emptied, but for
common words, when a task ends (`at_rest`): idle workers hold one tokenizer and little else.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bounds of a worker's caches in bytes; beyond, half of the entries go. They bound memory and never change a result.
PIECE_BYTES, CHUNK_BYTES, JOIN_BYTES = 64 << 20, 20 << 20, 8 << 20
#: What an idle worker keeps of its words.
REST_BYTES = 24 << 20
#: What a cache entry takes besides its characters and ids.
PIECE_EXTRA, CHUNK_EXTRA, JOIN_EXTRA = 190, 600, 400
WINDOW = 16
MEAN_CHUNK = 512


class Bounded:
    """A cache (its `map`) that forgets half of its entries when it holds too many bytes: the newer half where common
    keys come first (`common`), else the older half."""

    def __init__(self, most: int, extra: int, size=None, common: bool = False):
        self.map: dict = {}
        self.most, self.extra, self.held, self.common = most, extra, 0, common
        self.sizes = (lambda ks, vs: sum(map(size, ks, vs))) if size else (lambda ks, vs: sum(map(len, ks)) + sum(map(len, vs)))

    def add(self, keys: list, values: list) -> None:
        self.map.update(zip(keys, values, strict=True))
        self.held += self.sizes(keys, values) + self.extra * len(keys)

    def trim(self, most: int | None = None) -> None:
        most = self.most if most is None else most
        while self.held > most:
            half = (len(self.map) + 1) // 2
            keys = list(self.map)
            self.map = {k: self.map[k] for k in (keys[: len(keys) - half] if self.common else keys[half:])}
            self.held = self.sizes(self.map.keys(), self.map.values()) + self.extra * len(self.map)

    def empty(self) -> None:
        self.map.clear()
        self.held = 0


@contextlib.contextmanager
def at_rest(encoder):
    """Empties the encoder's caches, but for common words, when the task is over and gives the memory back: workers stay when their tasks have ended."""
    try:
        yield encoder
    finally:
        encoder.forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)


def spaced(spec: dict) -> bool:
    """Whether a tokenizer file (parsed) is of the kind that PieceEncoder can cut at spaces: white space is squeezed and dropped,
    and every other part works character by character or on pre-tokens."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = norm.get("normalizers", [norm])
    cuts = pre.get("pretokenizers", [pre])
    split = [c for c in cuts if c.get("type") == "Split"]
    return bool(
        {s.get("type") for s in steps} <= {"NFC", "Replace", "Lowercase"}
        and all(s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps if s.get("type") == "Replace")
        and len(split) == 1 and split[0]["behavior"] == "Removed" and split[0]["invert"]
        and re.search(r"\[\^\\s", split[0]["pattern"].get("Regex", "")) and "(?" not in split[0]["pattern"]["Regex"]
        and all(c.get("type") == "Split" or (c.get("type") == "ByteLevel" and not c["add_prefix_space"] and not c.get("use_regex", True)) for c in cuts)
        and not any(c.isspace() or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []) for c in t["content"])
    )


def pure(spec: dict) -> bool:
    """Whether a tokenizer file (parsed) merges the characters of the text and does nothing else."""
    model = spec.get("model") or {}
    return bool(
        model.get("type") == "BPE" and not spec.get("normalizer") and not spec.get("pre_tokenizer") and not spec.get("added_tokens")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    )


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@functools.lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(maxsize=8)
def vocabulary(path: str) -> int:
    """Ids lie below this number."""
    return max(load(path).get_vocab(with_added_tokens=True).values()) + 1


class PieceEncoder:
    """Texts to bytes of little-endian ids (width 2 or 4)."""

    #: Lower-case Latin words are pre-tokens of their own, and so are the marks behind them: each part is looked up by itself.
    LETTERS = "[a-z\u00df-\u00f6\u00f8-\u00ff]+"
    TAIL = re.compile(f"({LETTERS})([!-&(-/:-@\\[-^`{{-~]*)")

    def __init__(self, path: str, most: int = PIECE_BYTES):
        self.tok, spec = load(path), _spec(path)
        norm, model = spec.get("normalizer") or {}, spec.get("model") or {}
        self.whole, self.pure = not spaced(spec), pure(spec)
        self.dtype = "<u2" if vocabulary(path) <= 1 << 16 else "<u4"
        special = [t["content"] for t in spec.get("added_tokens", [])]
        end = model.get("end_of_word_suffix")
        # a letter class in the pre-tokenizer, marks apart from letters, and word ends that tell where a word's ids stop
        self.tails = bool(
            not self.whole and end and not model.get("continuing_subword_prefix")
            and any(s.get("type") == "Lowercase" for s in norm.get("normalizers", []))
            and "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\")
            and all(s.startswith("<") for s in special)
        )
        if self.tails:
            self.slim = self._slim(self.tok)
            self.ends = np.zeros(vocabulary(path), bool)
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(end)]] = True
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in set(shown)]
            self.byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.cache = Bounded(most, PIECE_EXTRA, common=True)

    @staticmethod
    def _slim(tok):
        """The same model (shared, not copied) for words that are already normal, lower-case and spelled in the byte alphabet."""
        from tokenizers import Tokenizer, pre_tokenizers

        slim = Tokenizer(tok.model)
        slim.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return slim

    def forget(self) -> None:
        self.cache.trim(min(REST_BYTES, self.cache.most))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of LETTERS words, many to a call: a word ends at the id of a word end."""
        spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(self.byte_chars) for w in words]
        runs = [" ".join(spelled[i : i + 512]) for i in range(0, len(spelled), 512)]
        ids = np.array([i for e in self.slim.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids], self.dtype)
        stops = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
        if len(stops) != len(words):
            return self._library(words)
        raw = ids.tobytes()
        stops = stops.tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def fold(self, text: str) -> str:
        """The same text for the tokenizer, with fewer distinct pieces: Latin-1 texts are normal and lower-case letter by letter."""
        if self.tails and "<" not in text:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
            return text.lower()
        return text

    def pieces(self, text: str) -> list[str]:
        return self.fold(text).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def learn(self, words: set[str]) -> None:
        """Encodes pieces that the cache lacks."""
        cache, other, tails = self.cache, [], []
        known = cache.map
        for w in words:
            if self.tails and (m := self.TAIL.fullmatch(w)):
                tails.append((w, m[1], m[2]))
            else:
                other.append(w)
        letters = list({a for _, a, _ in tails}.difference(known))
        other.extend({b for _, _, b in tails}.difference(known))
        for i in range(0, len(letters), 8192):
            part = letters[i : i + 8192]
            cache.add(part, self._words(part))
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            cache.add(part, self._library(part))
        both = [(w, known[a] + known[b]) for w, a, b in tails if b]
        cache.add([w for w, _ in both], [x for _, x in both])

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return [x for t in texts for x in self._library([t])]
        out = []
        for part in parts(texts):
            self.cache.trim()
            words = [self.pieces(t) for t in part]
            self.learn(set().union(*words).difference(self.cache.map))
            get = self.cache.map.__getitem__
            out.extend([b"".join(map(get, w)) for w in words])
        return out


def parts(texts: list[str], chars: int = 1 << 20):
    """Runs of texts of about that many characters, so that what a run needs is bounded whatever a batch holds."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= chars:
            yield run
            run, n = [], 0
    if run:
        yield run


def slices(column: pa.Array, chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(place, texts) for runs of a string column of about that many characters; a run at a time is turned into Python strings."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, before = 0, 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(upto, before + chars, "right")))
        yield lo, column.slice(lo, hi - lo).to_pylist()
        lo, before = hi, int(upto[hi - 1])


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One per worker process."""
    return PieceEncoder(path)


class ChunkEncoder:
    """Texts to (ids, their decimal form, decoded text) by content-defined chunks.

    "words": a chunk's entry holds its head (up to its first space), the encoded core between its first and last space, and
    its tail. Head and tail wait for their neighbours: tail + head of two chunks that meet, the glue, is encoded with
    one core word on either side, then two, four and so on until the ids of these words come out as in the cores; if they never do,
    the library encodes the whole text. "pure": an entry holds a chunk's ids and the places where its tokens end;
    windows of tokens around a join grow in the same way, at most to all that lies on both sides.
    """

    def __init__(self, path: str, most: int = CHUNK_BYTES, mean: int = MEAN_CHUNK):
        self.words = piece_encoder(path)
        self.tok, self.mask = self.words.tok, np.uint32(mean - 1)
        self.kind = "pure" if self.words.pure else "whole" if self.words.whole else "words"
        self.alphabet = {t for t in self.tok.get_vocab() if len(t) == 1} if self.kind == "pure" else set()
        self.chunks = Bounded(most, CHUNK_EXTRA, lambda k, v: 18 * len(k) if self.kind == "pure" else 2 * len(k) + (len(v[2]) if v else 0))
        self.joins = Bounded(JOIN_BYTES, JOIN_EXTRA, lambda k, v: sum(map(len, k)) + len(v))
        size = vocabulary(path)
        self.decimal = [str(i) for i in range(size)]
        # Without a decoder, decode() joins the tokens by one space.
        self.token = [self.tok.id_to_token(i) or "" for i in range(size)] if self.tok.decoder is None else None
        #: characters that chunks were encoded for, and joins encoded again with a grown window: what tests look at
        self.encoded = self.grown = 0

    def forget(self) -> None:
        self.chunks.empty()
        self.joins.empty()
        self.words.forget()

    def cuts(self, text: str) -> list[int]:
        """Places where the hash of the last WINDOW code points has its low bits clear; they depend on nothing else."""
        if len(text) <= WINDOW:
            return []
        h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        step, factor = 1, np.uint32(0x01000193)
        while step < WINDOW:  # h covers 2 * step code points after each round
            h[step:] = h[step:] + h[:-step] * factor
            factor = np.uint32((int(factor) * int(factor)) & 0xFFFFFFFF)
            step *= 2
        at = np.flatnonzero(((h >> np.uint32(13)) & self.mask) == 0)
        return at[at >= WINDOW].tolist()

    def _cut(self, text: str) -> list[str]:
        edges = [0, *self.cuts(text), len(text)]
        return [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _out(self, ids: list[int]) -> tuple[int, str, str]:
        if self.token:
            decoded = " ".join(map(self.token.__getitem__, ids))
        else:
            decoded = self.tok.decode(ids, skip_special_tokens=False)
        return len(ids), " ".join(map(self.decimal.__getitem__, ids)), decoded

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        run = {"words": self._by_words, "pure": self._by_merges, "whole": lambda part: map(self._whole, part)}[self.kind]
        out = []
        for part in parts(texts):
            for cache in (self.chunks, self.joins, self.words.cache):
                cache.trim()
            out.extend(map(self._out, run(part)))
        return out

    # "words"

    def _learn(self, chunks: set[str]) -> None:
        """Encodes chunks that are not known, all their new words in one call."""
        entries, words, names = [], [], []
        for chunk in chunks:
            a, b = chunk.find(" "), chunk.rfind(" ")
            names.append(chunk)
            if a == b:  # no core
                entries.append(None)
                continue
            core = chunk[a + 1 : b]
            self.encoded += len(core)
            words.append(self.words.pieces(core))
            entries.append((chunk[:a], core, b"", chunk[b + 1 :]))
        self.words.learn(set().union(*words).difference(self.words.cache.map))
        get, each = self.words.cache.map.__getitem__, iter(words)
        self.chunks.add(names, [e and (e[0], e[1], b"".join(map(get, next(each))), e[3]) for e in entries])

    def _known(self, text: str) -> bytes:
        """The ids of a text whose pieces have mostly been learned."""
        try:
            return b"".join(map(self.words.cache.map.__getitem__, self.words.pieces(text)))
        except KeyError:
            return self.words.encode([text])[0]

    @staticmethod
    def _words(core: str, n: int, last: bool) -> str:
        """The last (or first) n words of a core, or all of it."""
        if not core:
            return ""
        return " ".join(core.rsplit(" ", n)[-n:]) if last else " ".join(core.split(" ", n)[:n])

    def _repair(self, keys: list[tuple[str, str, str]], wide: dict) -> dict[tuple, bytes | None]:
        """The ids of each glue. keys: (left word, glue, right word); wide: the cores that they come from. None: no window agrees."""
        out, n = {}, 1
        while keys:
            sides = [(self._words(wide[k][0], n, True), self._words(wide[k][1], n, False)) for k in keys]
            self.words.learn({p for side in sides for x in side for p in self.words.pieces(x)}.difference(self.words.cache.map))
            got = self.words._library([f"{a} {k[1]} {b}" for k, (a, b) in zip(keys, sides, strict=True)])
            again = []
            for k, (left, right), raw in zip(keys, sides, got, strict=True):
                a, b = self._known(left), self._known(right)
                if raw.startswith(a) and raw.endswith(b) and len(raw) >= len(a) + len(b):
                    out[k] = raw[len(a) : len(raw) - len(b)]
                elif left == wide[k][0] and right == wide[k][1]:
                    out[k] = None
                else:
                    again.append(k)
            self.grown += len(again)
            keys, n = again, 2 * n
        return out

    def _by_words(self, texts: list[str]) -> Iterator[list[int]]:
        flat = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
        chunks = [self._cut(t) for t in flat]
        self._learn(set().union(*chunks).difference(self.chunks.map))
        plans, wide = [], {}
        for row in chunks:  # cores and, between them, the joins
            plan, left, glue = [], "", ""
            for part in row:
                entry = self.chunks.map[part]
                if entry is None:
                    glue += part
                    continue
                head, core, raw, tail = entry
                plan.append(self._meet(left, glue + head, core, wide))
                plan.append(raw)
                left, glue = core, tail
            plan.append(self._meet(left, glue, "", wide))
            plans.append(plan)
        new = [k for k in wide if k not in self.joins.map]
        found = self._repair(new, wide)
        kept = [k for k in new if found[k] is not None and len(k[1]) <= 256]
        self.joins.add(kept, [found[k] for k in kept])
        dtype = self.words.dtype
        for text, plan in zip(texts, plans, strict=True):
            raws = [x if isinstance(x, bytes) else found[x] if x in found else self.joins.map[x] for x in plan]
            yield self._whole(text) if None in raws else np.frombuffer(b"".join(raws), dtype).tolist()

    def _meet(self, left: str, glue: str, right: str, wide: dict):
        if not glue:
            return b""
        key = (self._words(left, 1, True), glue, self._words(right, 1, False))
        wide.setdefault(key, (left, right))
        return key

    # "pure"

    def _by_merges(self, texts: list[str]) -> Iterator[list[int]]:
        for text in texts:
            if set(text) <= self.alphabet:
                yield self._merge(self._cut(text)) if text else []
            else:  # characters outside the vocabulary are dropped or replaced
                yield self._whole(text)

    def _encode(self, text: str) -> tuple[list[int], list[int]]:
        e = self.tok.encode(text, add_special_tokens=False)
        return e.ids, [b for _, b in e.offsets]

    def _merge(self, row: list[str]) -> list[int]:
        ids, ends, at = [], [], 0  # of the text so far
        text = "".join(row)
        for part in row:
            if part not in self.chunks.map:
                self.encoded += len(part)
                self.chunks.add([part], [self._encode(part)])
            more, stops = self.chunks.map[part]
            n = 1
            while ids and more:
                lo, hi = max(0, len(ids) - n), min(n, len(more))
                a, b = ends[lo - 1] if lo else 0, at + stops[hi - 1]
                got, places = self._encode(text[a:b])
                if (lo == 0 or got[0] == ids[lo]) and (hi == len(more) or got[-1] == more[hi - 1]):
                    ids[lo:], ends[lo:] = got, [a + p for p in places]
                    more, stops = more[hi:], stops[hi:]
                    break
                n *= 2
                self.grown += 1
            ids.extend(more)
            ends.extend(at + p for p in stops)
            at += len(part)
        return ids


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)
