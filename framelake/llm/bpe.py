"""BPE encoding and decoding with prefix sharing.

Every prefix of a word has one BPE encoding, and that encoding is the one of a shorter prefix plus one last token. So a
trie of the distinct words needs one state, the last token, per node, and words that begin alike share the work.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from framelake.llm.common import pieces, returning, words_of


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


#: Bytes of text whose distinct chunks are worked out together; words that share one trie.
PIECE, TRIE_WORDS = 4 << 20, 8192
#: ASCII marks but the apostrophe: after a word, a run of them is one piece.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Latin letters whose lower case and byte symbols are known without the library.
LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: The normaliser and the split pattern for which texts may be cut at white space, and words and marks be
#: told apart, before the library sees them.
NORMALISER = ["NFC", "Replace \\s+", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def check_spec(spec: dict) -> None:
    """Refuses vocabulary files that normalise or split in another way than `Splitter` and `ChunkIds` count on."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    named = [f"{x['type']} {x['pattern'].get('Regex')}" if x["type"] == "Replace" else x["type"] for x in steps]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    patterns = [x.get("pattern", {}).get("Regex") if x["type"] == "Split" else x["type"] for x in splits]
    if named != NORMALISER or patterns != [PATTERN, "ByteLevel"] or spec.get("decoder") or spec["model"].get("unk_token"):
        raise ValueError("a byte-level BPE vocabulary with lower case, dropped white space and no decoder is needed")


class Splitter:
    """Cuts white-space-free chunks into the pieces that the vocabulary's normaliser and pre-tokeniser give.

    Added tokens inside a chunk come out as their id. Chunks are cut at ASCII white space only, which the normaliser
    drops, so a text's pieces are those of its chunks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        check_spec(spec)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_added = re.compile("|".join(map(re.escape, self.added)) or r"(?!)")
        symbols = byte_symbols()
        #: the bytes of lower-case Latin letters that don't stand for themselves
        self.shifted = [(chr(b), symbols[b]) for b in (0x9F, 0xA0, 0xAD)]

    def _general(self, text: str) -> list[str]:
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def symbols(self, word: str) -> str:
        """The byte symbols of a word of lower-case Latin letters, which is one piece."""
        word = word.encode().decode("latin-1")
        for byte, symbol in self.shifted:
            word = word.replace(byte, symbol)
        return word

    def split(self, chunk: str) -> list[str | int]:
        if "<|" not in chunk:
            return self._general(chunk)
        out: list[str | int] = []
        start = 0
        for found in self.at_added.finditer(chunk):
            out += [*self._general(chunk[start : found.start()]), self.added[found[0]]]
            start = found.end()
        return out + self._general(chunk[start:])


class PrefixTrie:
    """Encodes sets of distinct pieces (strings of byte symbols) by a depth-first walk over their trie."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, (list, tuple)) else merge.split(" ")
            made = vocab[a + b]
            self.rank[vocab[a], vocab[b]] = k
            self.parts.setdefault(made, (vocab[a], vocab[b]))
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for text, token in vocab.items():
            if text.endswith(self.end) and len(text) > len(self.end) and self.end:
                self.final[text.removesuffix(self.end)] = token
            else:
                self.inner[text] = token
        self.size = {v: len(k) for k, v in [*self.inner.items(), *self.final.items()]}
        self.fits: dict[int, bool] = {}
        # a token that its own text doesn't encode to never occurs in an encoding
        for table in (self.inner, self.final):
            for text, token in [x for x in table.items() if x[1] in self.parts]:
                if not self._reachable(token):
                    del table[text]
        self.reach = {id(table): self._reach(table) for table in (self.inner, self.final)}
        self.longest = max(max(x.values(), default=2) for x in self.reach.values())

    @staticmethod
    def _reach(table: dict[str, int]) -> dict[str, int]:
        """The length of the longest token for each end of three symbols."""
        out: dict[str, int] = {}
        for text in table:
            out[text[-3:]] = max(len(text), out.get(text[-3:], 0))
        return out

    def _reachable(self, token: int) -> bool:
        a, b = self.parts[token]
        return (a not in self.parts or self._reachable(a)) and (b not in self.parts or self._reachable(b)) and self._meets(a, b, self.rank[a, b])

    def _meets(self, left: int, right: int, limit: float) -> bool:
        """True if no merge across the seam of two tokens comes before merge number `limit` and before theirs are made.

        Along the seam the tokens are undone from the last merge backwards; a pair of neighbours that could merge
        before the later of their own next merges would have taken the seam.
        """
        made = self.rank
        while True:
            if made.get((left, right), limit) < limit:
                return False
            made_left = made[self.parts[left]] if left in self.parts else -1
            made_right = made[self.parts[right]] if right in self.parts else -1
            if made_left < 0 and made_right < 0:
                return True
            # at equal rank the left one is made first, so the right one is undone first
            if made_left > made_right:
                limit, left = made_left, self.parts[left][1]
            else:
                limit, right = made_right + 1, self.parts[right][0]

    def adjoin(self, left: int, right: int) -> bool:
        """True if the encoding of both tokens' text is these two tokens."""
        key = left << 32 | right
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 150_000:
                self.fits.clear()
            known = self.fits[key] = self._meets(left, right, float("inf"))
        return known

    def last_token(self, end: str, n: int, table: dict[str, int], before: list[int]) -> int:
        """The last token of a text of `n` symbols with the given end; before[k] is that of its first k symbols."""
        skipped = n - len(end)
        for start in range(max(0, n - self.reach[id(table)].get(end[-3:], 2)), n):
            token = table.get(end[start - skipped :])
            if token is not None and (start == 0 or self.adjoin(before[start], token)):
                return token
        raise ValueError(f"no encoding for {end!r}")

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """Token ids of each distinct non-empty word, by tries of `TRIE_WORDS` neighbours in order, so that tries stay small."""
        words = sorted(words)
        out: dict[str, list[int]] = {}
        for k in range(0, len(words), TRIE_WORDS):
            out |= self.encode_trie(words[k : k + TRIE_WORDS])
        return out

    def encode_trie(self, words: list[str]) -> dict[str, list[int]]:
        """Token ids of each word, by one trie."""
        root: dict = {}
        for word in words:
            node = root
            for symbol in word[:-1]:
                node = node.setdefault(symbol, {})
            node[""] = node.get("", "") + word[-1]
        out: dict[str, list[int]] = {}
        last, path = [-1], []
        # of a long path only the end that a token may cover goes along
        stack: list[tuple[int, str, dict]] = [(0, "", root)]
        while stack:
            depth, end, node = stack.pop()
            if depth:
                del last[depth:], path[depth - 1 :]
                path.append(end[-1])
                last.append(self.last_token(end, depth, self.inner, last))
            for symbol in node.get("", ()):
                ids = [self.last_token(end + symbol, depth + 1, self.final, last)]
                at = depth + 1 - self.size[ids[0]]
                while at:
                    ids.append(last[at])
                    at -= self.size[last[at]]
                out["".join(path[:depth]) + symbol] = ids[::-1]
            stack.extend((depth + 1, (end + symbol)[-self.longest :], child) for symbol, child in node.items() if symbol)
        return out


_loaded: dict[tuple[str, str], object] = {}


def local_file(path: str) -> str:
    """A vocabulary file on this machine: the path itself, or the copy that `SparkContext.addFile` has sent along."""
    import os

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def per_worker(kind: str, path: str, make: Callable[[str], object]):
    """Built once in each Python worker."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = make(local_file(path))
    return _loaded[kind, path]


class Kept:
    """Values of the keys that were asked for of late: at most two generations of `most` entries."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, keys: list[str], make: Callable[[list[str]], Iterable[tuple[str, bytes]]]) -> list[bytes]:
        """The values of distinct keys; `make` gives those of new ones."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = [k for k in keys if k not in young]
        new = []
        for key in missing:
            if (value := old.get(key)) is None:
                new.append(key)
            else:
                young[key] = value
        young.update(make(new))
        return [young[k] for k in keys]


class ChunkIds:
    """Token ids of chunks; `encode_new` gives those of new distinct pieces, and a worker keeps some between batches.

    Pieces and whole chunks are kept apart: 'fÃ¼r' is the piece of 'für', but as a chunk it has pieces of its own.
    """

    def __init__(self, splitter: Splitter, encode_new: Callable[[list[str]], dict[str, list[int]]], width: str = "<u4", most: int = 100_000):
        self.splitter, self.encode_new, self.width = splitter, encode_new, width
        self.pieces, self.chunks = Kept(most), Kept(most // 4)

    def _encode(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        encoded = self.encode_new(pieces)
        raw = np.fromiter(chain.from_iterable(encoded.values()), self.width).tobytes()
        ends = list(accumulate(map(len, encoded.values()), initial=0))
        size = np.dtype(self.width).itemsize
        return zip(encoded, (raw[size * a : size * b] for a, b in pairwise(ends)), strict=True)

    def _encode_chunks(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        cut = [self.splitter.split(c) for c in chunks]
        names = list({p: None for parts in cut for p in parts if p.__class__ is str})
        known = dict(zip(names, self.pieces.of(names, self._encode), strict=True))
        for chunk, parts in zip(chunks, cut, strict=True):
            yield chunk, b"".join([known[p] if p.__class__ is str else np.array(p, self.width).tobytes() for p in parts])

    def of(self, chunks: pa.Array) -> pa.Array:
        """Ids of each distinct chunk as packed unsigned integers of numpy type `width`.

        Latin words with or without marks behind them are taken apart in whole columns; other chunks go one by one.
        """
        bare = pc.utf8_rtrim(chunks, MARKS)
        plain = pc.match_substring_regex(bare, f"^{LATIN}$")
        words = pc.utf8_lower(bare.filter(plain)).dictionary_encode()
        marks = pc.replace_substring_regex(chunks.filter(plain), f"^{LATIN}", "", max_replacements=1).dictionary_encode()
        symbols = [w if w.isascii() else self.splitter.symbols(w) for w in words.dictionary.to_pylist()]
        tails = marks.dictionary.to_pylist()
        word_ids = pa.array(self.pieces.of(symbols, self._encode), pa.large_binary()).take(words.indices)
        tail_ids = {"": b""} | dict(zip(some := [t for t in tails if t], self.pieces.of(some, self._encode), strict=True))
        mark_ids = pa.array([tail_ids[t] for t in tails], pa.large_binary()).take(marks.indices)
        others = chunks.filter(pc.invert(plain)).to_pylist()
        other_ids = pa.array(self.chunks.of(others, self._encode_chunks), pa.large_binary())
        both = pa.concat_arrays([pc.binary_join_element_wise(word_ids, mark_ids, pa.scalar(b"", pa.large_binary())), other_ids])
        is_plain = plain.to_numpy(zero_copy_only=False)
        return both.take(pa.array(np.where(is_plain, np.cumsum(is_plain) - 1, len(words) + np.cumsum(~is_plain) - 1)))


def chunk_ids(path: str) -> ChunkIds:
    """Through the prefix trie."""
    return per_worker("trie", path, lambda p: ChunkIds(Splitter(p), PrefixTrie(p).encode))


def token_texts(path: str) -> pa.Array:
    """Of each id the token's string and a space; ids that the file leaves out are empty."""

    def make(p: str) -> pa.Array:
        spec = json.load(open(p, encoding="utf-8"))
        texts = {v: k for k, v in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        return pa.array([texts[k].encode() + b" " if k in texts else b"" for k in range(max(texts) + 1)], pa.large_binary())

    return per_worker("texts", path, make)


def flat_ids(texts: pa.Array, ids_of: ChunkIds) -> tuple[np.ndarray, memoryview]:
    """The packed ids of all texts one after the other, and where each text's begin and end in bytes."""
    offsets, words = words_of(texts)
    coded = words.dictionary_encode()
    taken = ids_of.of(coded.dictionary).take(coded.indices)
    bounds, data = spans(taken)
    return bounds[offsets], data


def spans(packed: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Ends of the values of a large binary array without nulls (a zero before them), and their bytes."""
    data = packed.buffers()[2]
    return np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1, 8 * packed.offset), memoryview(data) if data else memoryview(b"")


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with `keep_ids` ids and decoded.

    `path`: a byte-level BPE vocabulary file with word ends and no decoder, for which decoding joins the tokens' strings
    with spaces; files that normalise or split otherwise are refused (`check_spec`). Null texts are empty. Each row
    stands for itself: repeated or null doc_ids change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, texts = chunk_ids(path), token_texts(path)
        for whole in batches:
            for batch in pieces(whole, PIECE):
                bounds, raw = flat_ids(batch.column("text"), ids_of)
                ids = np.frombuffer(raw, "<i4", bounds[-1] // 4)
                starts, ends = bounds[:-1].tolist(), bounds[1:].tolist()
                at, said = spans(texts.take(pa.array(ids)))
                spoken = [said[a : b - 1] if b > a else b"" for a, b in zip(at[bounds[:-1] // 4].tolist(), at[bounds[1:] // 4].tolist(), strict=True)]
                columns = {
                    "doc_id": pc.cast(batch.column("doc_id"), pa.int64()),
                    "n_tokens": pa.array(np.diff(bounds) // 4),
                    "ids_sha256": pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(starts, ends, strict=True)], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in spoken], pa.string()),
                }
                if keep_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array((bounds // 4).astype(np.int32)), pa.array(ids))
                    columns["decoded"] = pa.array([bytes(x) for x in spoken], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    more = ", ids array<int>, decoded string" if keep_ids else ""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(returning(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
