"""BPE encoding and decoding by speculation and verification.

A word is cut greedily into the longest tokens of the vocabulary. The proposal
equals the result of the merges exactly when every token reproduces itself and
every adjacent pair is compatible, that is, no merge would cross the boundary
between the two. The pairs of all new words of a block are tested together
with NumPy; only words with a failing pair are merged exactly.

Words are encoded once per worker and kept in a bounded cache, so the operator
is a map without a shuffle. Texts are processed in blocks of words, so a very
long text needs no more memory than a few copies of itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sourcelens.llm import common

#: Words kept by a worker; beyond it only short ones stay (most of a text's words are short), results do not change.
CACHE_WORDS = 400_000
KEPT_CHARS = 8
#: Longer words are encoded without being kept.
CACHE_CHARS = 64
#: Words that are encoded and hashed together.
BLOCK_WORDS = 65_536
#: Characters of a text that are cut into words together.
BLOCK_CHARS = 1 << 18

#: Marks words that are in the byte alphabet already; words of the simple range never hold it.
MARK = "\uffff"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(shown)))
    return [out[b] for b in range(256)]


class BytePairCoder:
    """Encodes and decodes with one tokenizer file of the `tokenizers` library's JSON format."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.alphabet = byte_alphabet()
        self.library = Tokenizer.from_file(path)  # normalises and cuts texts beyond the simple range
        self._rank_merges(model["merges"])
        self._keep_self_reproducing()
        self._cut_patterns()
        self.cache: dict[str, tuple[str, int, str]] = {}
        self.passing: list[str] = []  # long words that leave the cache after their block
        self.exact = 0  # words that needed exact merging

    def _rank_merges(self, merges: list) -> None:
        """Ranks of the merges, and for each token the rank and halves of the merge that makes it."""
        n = max(self.vocab.values()) + 1
        self.rank_of = np.full(n, -1, np.int64)  # -1: a token of the base alphabet
        self.left, self.right = np.arange(n), np.arange(n)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = np.empty(len(merges), np.int64), np.arange(len(merges))
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            i, j, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge[i, j] = (rank, made)
            keys[rank] = i * n + j
            if self.rank_of[made] < 0:
                self.rank_of[made], self.left[made], self.right[made] = rank, i, j
        self.n = n
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]

    def _keep_self_reproducing(self) -> None:
        """Proposals may only use tokens whose own halves are compatible, all the way down."""
        made = np.flatnonzero(self.rank_of >= 0)
        good = np.ones(self.n, bool)
        good[made] = self.compatible(self.left[made], self.right[made], self.rank_of[made])
        for t in made[np.argsort(self.rank_of[made], kind="stable")]:
            good[t] &= good[self.left[t]] and good[self.right[t]]
        self.proposable = {t: i for t, i in self.vocab.items() if good[i]}
        self.starts: dict[str, int] = {}  # every beginning of a proposable token: the token's id if it is one itself, else -1
        for t, i in self.proposable.items():
            body = t.removesuffix(self.suffix) if self.suffix else t
            for end in range(1, len(body) + 1):
                self.starts.setdefault(body[:end], -1)
            if body == t:
                self.starts[t] = i

    def _cut_patterns(self) -> None:
        """The simple range is U+0000 to U+02FF: NFC leaves it alone and lower() has no context there."""
        kinds = {"L": "", "N": ""}
        for cp in range(0x300):
            kind = unicodedata.category(chr(cp))[0]
            if kind in kinds:
                kinds[kind] += re.escape(chr(cp))
        space = r"\t-\r \x85\xa0"
        letters, digits = kinds["L"], kinds["N"]
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+")
        self.beyond = re.compile("[^\x00-˿]")
        self.gap = re.compile(f"[{space}]")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    # words of a text ------------------------------------------------------

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Blocks of words of the text; a special token stands in a block of its own as its string."""
        for part in self.specials.split(text) if self.specials and "<|" in text else [text]:
            if part in self.special:
                yield [part]
            elif part:
                yield from self._words(part)

    def _words(self, part: str) -> Iterator[list[str]]:
        if self.beyond.search(part):
            # the library's own Unicode tables decide; it returns words in the byte alphabet
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
            yield [MARK + w for w, _ in cut]
            return
        part, at = part.lower(), 0
        while at < len(part):
            end = at + BLOCK_CHARS
            if end < len(part):  # words never contain white space
                gap = self.gap.search(part, end)
                end = gap.start() if gap else len(part)
            yield self.cut.findall(part, at, end) if end - at < len(part) else self.cut.findall(part)
            at = end

    # speculation and verification ----------------------------------------

    def symbols(self, word: str) -> str:
        """The word in the byte alphabet; marked words are in it already."""
        if word[0] == MARK:
            return word[1:]
        return word if word.isascii() and word.isprintable() else "".join(self.alphabet[b] for b in word.encode())

    def propose(self, symbols: str) -> list[int]:
        """Greedy longest match; the last token carries the end of the word."""
        out, at, n, starts, suffix = [], 0, len(symbols), self.starts, self.suffix
        while at < n:
            end, stop, best = at + 1, at + 1, -1
            while end <= n and (i := starts.get(symbols[at:end])) is not None:
                if i >= 0 and (end < n or not suffix):
                    best, stop = i, end
                end += 1
            if end > n and suffix and (i := self.proposable.get(symbols[at:] + suffix)) is not None:
                best, stop = i, n
            out.append(best)
            at = stop
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens whether no merge crosses their boundary (before the rank `below`, if given).

        Undoes the merges of both tokens from the last to the first. Whenever the
        parts at the boundary could merge earlier than both of them are used up,
        the pair is incompatible.
        """
        a, b = first.astype(np.int64).copy(), second.astype(np.int64).copy()
        ok = np.ones(len(a), bool)
        # a crossing merge of rank r happens if it comes before the step that used up the part of
        # either side: on the left side equal ranks go first (merges run from the left)
        used_left = np.full(len(a), np.iinfo(np.int64).max) if below is None else below.astype(np.int64).copy()
        used_right = used_left.copy()
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)
            crosses = (rank < used_left[live]) & (rank <= used_right[live]) & (rank < np.iinfo(np.int64).max)
            if below is not None:
                crosses &= rank < below[live]
            ok[live[crosses]] = False
            live, x, y = live[~crosses], x[~crosses], y[~crosses]
            rx, ry = self.rank_of[x], self.rank_of[y]
            more = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            undo_left = rx > ry  # of equal ranks the right one happened last
            i, j = live[undo_left], live[~undo_left]
            used_left[i], a[i] = rx[undo_left], self.right[x[undo_left]]
            used_right[j], b[j] = ry[~undo_left], self.left[y[~undo_left]]
        return ok

    def merge_exactly(self, symbols: str) -> list[int]:
        """The merges in order of rank, then place, over a linked list with a heap."""
        n = len(symbols)
        ids = [self.vocab[s] for s in symbols[:-1]] + [self.vocab[symbols[-1] + self.suffix]]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j] = self.merge[x, y][1], False
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := self.merge.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (m := self.merge.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [ids[i] for i in range(n) if alive[i]]

    def encode_words(self, new: list[str]) -> list[list[int]]:
        """Token ids of each word: proposals, one vectorised test of all pairs, exact merging of the failing words."""
        symbols = [self.symbols(w) for w in new]
        proposed = [self.propose(s) for s in symbols]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(new)), sizes)
        inner = word[1:] == word[:-1]
        pairs, back = np.unique(flat[:-1][inner] * self.n + flat[1:][inner], return_inverse=True)
        ok = self.compatible(pairs // self.n, pairs % self.n)
        for w in np.unique(word[1:][inner][~ok[back]]):
            proposed[w] = self.merge_exactly(symbols[w])
            self.exact += 1
        return proposed

    def lookup(self, block: list[str]) -> dict[str, tuple[str, int, str]]:
        """For every word of the block: its ids as text, their number, its decoded text."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            for w in [w for w in cache if len(w) > KEPT_CHARS]:
                del cache[w]
            if len(cache) > CACHE_WORDS // 2:
                cache.clear()
        for w in self.passing:
            cache.pop(w, None)
        self.passing = [w for w in block if len(w) > CACHE_CHARS]
        if new := [w for w in set(block) if w not in cache]:
            for w in new:
                if w in self.special:
                    cache[w] = (str(self.special[w]), 1, w)
            plain = [w for w in new if w not in self.special]
            for w, ids in zip(plain, self.encode_words(plain) if plain else []):
                cache[w] = (" ".join(map(str, ids)), len(ids), " ".join(self.tokens[i] for i in ids))
        return cache

    def encode(self, text: str) -> list[int]:
        """Token ids of the whole text."""
        return [int(i) for block in self.pieces(text) if block for w in [self.lookup(block)] for x in block for i in w[x][0].split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode for files without a decoder: token strings joined by a space."""
        return " ".join(self.tokens[i] for i in ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids joined by a space, SHA-256 of the decoded text."""
        ids, decoded, n, gap = hashlib.sha256(), hashlib.sha256(), 0, b""
        for block in self.pieces(text):
            for at in range(0, len(block), BLOCK_WORDS):
                part = block[at : at + BLOCK_WORDS]
                found = list(map(self.lookup(part).__getitem__, part))
                a, counts, b = zip(*found)
                ids.update(gap + " ".join(a).encode())
                decoded.update(gap + " ".join(b).encode())
                n, gap = n + sum(counts), b" "
        return n, ids.hexdigest(), decoded.hexdigest()


_coders: dict[str, BytePairCoder] = {}


def coder(path: str) -> BytePairCoder:
    """The worker's coder for a tokenizer file."""
    if path not in _coders:
        _coders[path] = BytePairCoder(path)
    return _coders[path]


@common.tracked
def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode it again, and return digests of both.

    One row per row of docs: id_col, n_tokens, ids_sha256, decoded_sha256, and
    token_ids with with_ids. A null text counts as empty (no token; both digests
    are those of the empty string). Ids may be null or repeat: rows are mapped
    one by one. Other columns of docs are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            got = [own.digest(t.as_py() or "") for t in batch.column(1)]
            n, ids, decoded = zip(*got) if got else ((), (), ())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array([own.encode(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@common.tracked
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents."""
    return encode_decode(common.table(spark, sf_dir, "documents"), tokenizer_path())
