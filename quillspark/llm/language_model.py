"""LM scoring with an Elias-Fano n-gram trie.

First the words: 64-bit hashes in ascending order are the vocabulary, a word's number its place. Then the texts are numbered
once, four bytes a token, into a table in the shared folder, and everything after reads that. One pass counts the n-grams:
each task counts its own trigrams, sorted, and ships them packed to the shard of a hash of their first two words; what no
word follows is shipped too, so a shard has all of its bigrams and their counts. Levels of the trie are written to the
shared folder, bigrams first: monotone Elias-Fano pointers from contexts to children, the children's words made monotone
over the whole level by adding each to the last value before its range, interpolated absolute-discounting probabilities
quantised to 256 values, and the contexts' back-off weights, quantised likewise. As both words choose the shard, no
frequent word fills one; the bigrams' contexts' back-off weights are summed over the shards and kept beside the vocabulary.

Scoring maps the levels into memory. It takes the range of a context from the pointers, adds the word to the value before
that range and looks for its successor; a text's distinct n-grams in a batch are looked up once. What isn't found
backs off. The first token of a text is scored by its unigram, the end token last.

Model files are ``quillspark-lm-*`` in the shared folder; they are needed until the result has been read. Their size follows
the corpus; tasks map a bounded number of them at a time and hold none of it. Shards follow the number of tokens. Null text
is empty text (the end token alone). A long text is numbered and scored in one go. Repeated rows are counted and scored as
they come; a row with null id is used for training. With no training rows every word is unknown; no rows give no scores. The
result has the id and the named columns alone, so other columns don't matter. Words are known by 64-bit hashes: two of equal hash
would count as one. More than 2**32 different words raise.
"""

from __future__ import annotations

import atexit
import uuid
import zlib
from collections import OrderedDict, defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, record_batch, shared_dir, text_bytes
from .elias_fano import EliasFano

ORDER = 3
#: n-grams of an order that occur fewer times are counted but get no node of their own; all have one unless the caller says otherwise.
LEAST_COUNT = (1, 1, 1)
DISCOUNT = 0.8
#: Tokens for each shard.
SHARD_TOKENS = 2_000_000
#: Files that a worker holds mapped at a time.
MAPPED = 128
#: Bytes of files that a worker holds in memory, if the shared folder is on a store that can't be mapped.
READ = 256 << 20
#: Tokens that are numbered together in a task.
GROUP = 1 << 19
_END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # no word has white space in it


def held_out(ids: list) -> np.ndarray:
    """crc32 of the id as text, modulo 5, is 1. A null id isn't held out."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids], bool)


def token_groups(texts: list[bytes]):
    """(first text, last text, distinct hashes, number of each token, tokens of each text) over groups of texts."""
    first, held, sizes = 0, [], []

    def group(last, total):
        known: dict[bytes, int] = defaultdict(count().__next__)
        number = np.fromiter(map(known.__getitem__, chain.from_iterable(held)), np.int64, total)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
        if b"\n" in known:
            hashes[known[b"\n"]] = _END
        return first, last, hashes, number, np.array(sizes)

    total = 0
    for i, data in enumerate(texts):
        words = data.lower().split()
        words.append(b"\n")
        held.append(words)
        sizes.append(len(words))
        total += len(words)
        if total >= GROUP:
            yield group(i + 1, total)
            first, held, sizes, total = i + 1, [], [], 0
    if held:
        yield group(len(texts), total)


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = _starts(keys)
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Differences of the keys, byte plane by byte plane (they compress), and counts of as few bytes as do."""
    diff = np.diff(keys, prepend=keys.dtype.type(0))
    planes = np.ascontiguousarray(diff.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    width = np.min_scalar_type(int(counts.max()) if len(counts) else 0).itemsize
    return planes, bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _unpacked(planes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    diff = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")
    return np.cumsum(diff, dtype=np.uint64), np.frombuffer(counts, f"<u{counts[0]}", offset=1).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """256 steps of equal width between the least and the largest of ``x``, each with the mean of what falls on it, and the code of each element.

    log10 probabilities span some eight units, so none is off by more than a 32nd.
    """
    if not len(x):
        return np.zeros(256), np.zeros(0, np.uint8)
    low, width = x.min(), max(x.max() - x.min(), 1e-12)
    code = ((x - low) * (255.999 / width)).astype(np.uint8)
    n = np.bincount(code, minlength=256)
    return np.bincount(code, x, minlength=256) / np.maximum(n, 1), code


# --- files in the shared folder -------------------------------------------------------------------------------------


def _store(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///"))


def _save(uri: str, name: str, parts: dict[str, np.ndarray]) -> None:
    """Named arrays as one file: written aside and moved, so that a second attempt does no harm."""
    store, path = _store(uri)
    store.create_dir(path, recursive=True)
    aside = f"{path}/.{name}-{uuid.uuid4().hex}"
    arrays = {k: np.ascontiguousarray(v) for k, v in parts.items()}
    head, at = [], 0
    for k, v in arrays.items():
        head.append(f"{k}:{v.dtype.str}:{len(v)}:{at}")
        at += -(-v.nbytes // 8) * 8
    text = ";".join(head).encode()
    text += b" " * (-len(text) % 8)
    with store.open_output_stream(aside) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for v in arrays.values():
            out.write(v.tobytes() + bytes(-v.nbytes % 8))
    store.move(aside, f"{path}/{name}")


def _mapped(uri: str, name: str) -> tuple[dict[str, np.ndarray], int]:
    """A file's arrays, mapped, and the bytes of memory they take: none, or on a store that can't be mapped the whole file."""
    store, path = _store(uri)
    if isinstance(store, pafs.LocalFileSystem):
        raw, size = np.memmap(f"{path}/{name}", np.uint8, "r"), 0
    else:
        with store.open_input_stream(f"{path}/{name}") as data:
            raw = np.frombuffer(data.read(), np.uint8)
        size = len(raw)
    start = 8 + int(raw[:8].view("<u8")[0])
    out = {}
    for part in raw[8:start].tobytes().decode().strip().split(";"):
        k, kind, n, at = part.split(":")
        kind, at = np.dtype(kind), int(at) + start
        out[k] = np.asarray(raw[at : at + int(n) * kind.itemsize]).view(kind)
    return out, size


# --- the trie -------------------------------------------------------------------------------------------------------


class Level:
    """One shard of one order: contexts, their children's words, probabilities; and back-off weights of the contexts."""

    def __init__(self, parts: dict[str, np.ndarray]):
        # back-off weights of bigrams' contexts are with the vocabulary
        self.contexts = EliasFano(parts["contexts"])  # their keys: word numbers, or nodes of the shard's level below
        self.pointers = EliasFano(parts["pointers"])
        self.words = EliasFano(parts["words"])
        self.p_code, self.p_value, self.b_code, self.b_value = (parts[k] for k in ("p_code", "p_value", "b_code", "b_value"))

    @staticmethod
    def parts(context: np.ndarray, word: np.ndarray, log_p: np.ndarray, all_contexts: np.ndarray, log_b: np.ndarray) -> dict:
        """Rows in order of (context, word); ``all_contexts`` in order, with those that have no child left."""
        n, m = len(word), len(all_contexts)
        start = np.searchsorted(context, all_contexts, "left")
        pointers = np.append(start, n)
        largest = np.zeros(m, np.int64)
        filled = pointers[1:] > pointers[:-1]
        largest[filled] = word[pointers[1:][filled] - 1] + 1
        base = np.concatenate([[0], np.cumsum(largest)]).astype(np.int64)
        value = word + 1 + np.repeat(base[:-1], np.diff(pointers))
        p_value, p_code = _quantised(log_p)
        b_value, b_code = _quantised(log_b)
        top = int(all_contexts[-1]) + 1 if m else 1
        return {
            "contexts": EliasFano.encode(all_contexts, top), "pointers": EliasFano.encode(pointers, n + 1),
            "words": EliasFano.encode(value, int(base[-1]) + 1),
            "p_code": p_code, "p_value": p_value, "b_code": b_code, "b_value": b_value,
        }

    def word_of(self, node: np.ndarray) -> np.ndarray:
        """The last word of each node."""
        if not len(node):
            return node
        all_pointers = self.pointers.get(np.arange(self.contexts.n + 1))
        own = np.searchsorted(all_pointers, node, "right") - 1
        first = all_pointers[own]
        base = np.where(first > 0, self.words.get(np.maximum(first - 1, 0)), 0)
        return self.words.get(node) - base - 1

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the context or -1, node or -1) of each (context, word), in order of context."""
        where = np.full(len(context), -1, np.int64)
        node = where.copy()
        if not self.contexts.n or not len(context):
            return where, node
        # contexts come in order: keys are sorted by context and word
        fresh = np.concatenate([[True], context[1:] != context[:-1]])
        distinct, back = context[fresh], np.cumsum(fresh) - 1
        at = self.contexts.index(distinct)
        known = np.flatnonzero(at >= 0)
        first, last, base = (np.zeros(len(at), np.int64) for _ in range(3))
        if len(known) and self.words.n:
            first[known] = self.pointers.get(at[known])
            last[known] = self.pointers.get(at[known] + 1)
            base[known] = np.where(first[known] > 0, self.words.get(np.maximum(first[known] - 1, 0)), 0)
        where = at[back]
        live = np.flatnonzero((last > first)[back])
        if len(live):
            b = back[live]
            place = self.words.index(base[b] + word[live] + 1)
            node[live] = np.where((place >= first[b]) & (place < last[b]), place, -1)
        return where, node


class Model:
    """The model in ``uri``: vocabulary, and the levels of order 2 and 3 as far as they are there. At most ``MAPPED`` files are mapped at a time."""

    def __init__(self, uri: str, parts: int, shards: int, order: int, total: int):
        self.uri, self.parts, self.shards, self.order, self.total = uri, parts, shards, order, total
        #: Number of the first word of each part of the vocabulary, and the number of words.
        self.starts = _mapped(uri, "starts")[0]["starts"]
        self.distinct = int(self.starts[-1])
        self.shift = np.uint64(max(1, self.distinct.bit_length()))
        if self.shift > 32:
            raise OverflowError("a bigram's key has 64 bits: at most 2**32 different words")
        self.held: OrderedDict = OrderedDict()

    def _file(self, name: str, made=dict):
        """The file, mapped; the one that wasn't asked for the longest time is let go."""
        if name in self.held:
            self.held.move_to_end(name)
        else:
            parts, size = _mapped(self.uri, name)
            while self.held and (len(self.held) >= MAPPED or size and size + sum(n for _, n in self.held.values()) > READ):
                self.held.popitem(False)
            self.held[name] = made(parts), size
        return self.held[name][0]

    def words(self, part: int) -> dict:
        return self._file(f"words-{part}")

    def weights(self, part: int) -> dict:
        return self._file(f"backoff-{part}")

    def level(self, n: int, shard: int) -> Level:
        return self._file(f"level{n}-{shard}", Level)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of each hash. The vocabulary's parts divide the hashes by their top bits."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for p, at in _by(_part(hashes, self.parts), self.parts):
            own = self.words(p)
            if len(own["hashes"]):
                place = np.minimum(np.searchsorted(own["hashes"], hashes[at]), len(own["hashes"]) - 1)
                ok = own["hashes"][place] == hashes[at]
                number[at[ok]] = place[ok] + self.starts[p]
                count[at[ok]] = own["counts"][place[ok]]
        return number, count

    def of_words(self, number: np.ndarray, what: str) -> np.ndarray:
        """Counts or back-off weights of word numbers, 0 for -1."""
        out = np.zeros(len(number))
        known = np.flatnonzero(number >= 0)
        for p, at in _by(np.searchsorted(self.starts, number[known], "right") - 1, self.parts):
            at = known[at]
            own = number[at] - self.starts[p]
            if what == "count":
                out[at] = self.words(p)["counts"][own]
            else:
                out[at] = self.weights(p)["value"][self.weights(p)["code"][own]]
        return out

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def key(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Context and word in 64 bits: word numbers have at most 32, nodes of one shard fewer."""
        return context.astype(np.uint64) << self.shift | word.astype(np.uint64)

    def split(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (key >> self.shift).astype(np.int64), (key & ((np.uint64(1) << self.shift) - np.uint64(1))).astype(np.int64)

    def shard_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (_mixed(first.astype(np.uint64) * np.uint64(0x100000001B3) + second.astype(np.uint64)) % np.uint64(self.shards)).astype(np.int64)

    def look_up(self, n: int, shard: np.ndarray, context: np.ndarray, word: np.ndarray):
        """(context's weight or 0, node or -1, log10 probability of the node) for each n-gram; equal ones are looked up once."""
        weight, node, log_p = np.zeros(len(word)), np.full(len(word), -1, np.int64), np.zeros(len(word))
        for s, own in _by(shard, self.shards):
            level = self.level(n, s)
            # an unknown word stands behind all others
            asked = np.where(word[own] >= 0, word[own], self.distinct)
            distinct, back = np.unique(self.key(context[own], asked), return_inverse=True)
            where, got = level.find(*self.split(distinct))
            if n > 2 and len(level.b_code):
                weight[own] = np.where(where >= 0, level.b_value[level.b_code[np.maximum(where, 0)]], 0.0)[back]
            node[own] = got[back]
            if len(level.p_code):
                log_p[own] = level.p_value[level.p_code[np.maximum(got, 0)]][back]
        return weight, node, log_p

    def log_p(self, tokens: np.ndarray, position: np.ndarray) -> np.ndarray:
        """log10 probability of each token (its number, or -1) after those before it in its text."""
        best, node, home = np.zeros(len(tokens)), np.full(len(tokens), -1, np.int64), None
        if self.order >= 2:
            at = np.flatnonzero((position >= 1) & (tokens >= 0))
            at = at[tokens[at - 1] >= 0]
            shard = self.shard_of(tokens[at - 1], tokens[at])
            _, node[at], best[at] = self.look_up(2, shard, tokens[at - 1], tokens[at])
            home = np.zeros(len(tokens), np.int64)
            home[at] = shard
        # no bigram: the word by itself, less what the word before leaves to others
        alone = np.flatnonzero(node < 0)
        best[alone] = self.unigram(self.of_words(tokens[alone], "count"))
        if self.order >= 2:
            after = alone[(position[alone] >= 1)]
            after = after[tokens[after - 1] >= 0]
            best[after] += self.of_words(tokens[after - 1], "weight")
        if self.order >= 3:
            at = np.flatnonzero(position >= 2)
            at = at[node[at - 1] >= 0]
            # unknown words back off through the bigram too
            weight, found, p = self.look_up(3, home[at - 1], node[at - 1], tokens[at])
            best[at] = np.where(found >= 0, p, best[at] + weight)
        return best


def _by(of: np.ndarray, n: int):
    """(number, places) for each of the numbers below n that occur."""
    of = of.astype(np.min_scalar_type(n))  # small integers are sorted by their bytes
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, order[edges[k] : edges[k + 1]]


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


_models: dict = {}


def _model(args: tuple) -> Model:
    if args not in _models:
        _models.clear()
        _models[args] = Model(*args)
    return _models[args]


_BLOB = "shard int, keys binary, counts binary"


def _rows(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return record_batch(shard=pa.array([r[0] for r in rows], pa.int32()), keys=pa.array([r[1] for r in rows], pa.binary()), counts=pa.array([r[2] for r in rows], pa.binary()))


_WORDS_BLOB = f"{_BLOB}, words binary, times binary"


def _context_blobs(shard: np.ndarray, context: np.ndarray, word: np.ndarray, shards: int) -> pa.RecordBatch:
    """One task's counts of (context, word), a row for each shard: contexts with their numbers of words, words and counts in order of both."""
    rows = []
    for k, own in _by(shard, shards):
        contexts, at = np.unique(context[own], return_inverse=True)
        keys, n = _counted(at.astype(np.uint64) << np.uint64(32) | word[own].astype(np.uint64))
        sizes = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(contexts))
        width = np.min_scalar_type(int(n.max())).itemsize
        words = np.ascontiguousarray(keys.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        rows.append((k, *_packed(contexts, sizes), words, bytes([width]) + n.astype(f"<u{width}").tobytes()))
    columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), *[pa.binary()] * 4))]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "keys", "counts", "words", "times"])


def _merged_contexts(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """(distinct contexts in order, context's place, word, count) of the shard's distinct n-grams in order."""
    got = [_unpacked(k.as_py(), c.as_py()) for k, c in zip(rows.column("keys"), rows.column("counts"), strict=True)]
    contexts, at = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
    keys = np.repeat(at.astype(np.uint64) << np.uint64(32), np.concatenate([c for _, c in got]))
    del got, at
    keys |= np.concatenate([np.ascontiguousarray(np.frombuffer(w.as_py(), np.uint8).reshape(4, -1).T).reshape(-1).view("<u4") for w in rows.column("words")])
    keys, n = _counted(keys, np.concatenate([np.frombuffer(t := x.as_py(), f"<u{t[0]}", offset=1).astype(np.int64) for x in rows.column("times")]))
    return contexts, (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), n


def _squeezed(x: np.ndarray) -> np.ndarray:
    """Unsigned integers byte plane by byte plane, compressed: for files that are read once and as a whole."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return np.frombuffer(bytes([x.itemsize]) + zstandard.compress(planes, 1), np.uint8)


def _restored(raw: np.ndarray) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw[1:].tobytes()), np.uint8)
    return np.ascontiguousarray(planes.reshape(int(raw[0]), -1).T).reshape(-1).view(f"<u{raw[0]}")


def _small(n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of one byte each, those from 255 on apart."""
    return {"counts": _squeezed(np.minimum(n, 255).astype(np.uint8)), "more": n[n >= 255].astype(np.int64)}


def _whole(parts: dict[str, np.ndarray]) -> np.ndarray:
    n = _restored(parts["counts"]).astype(np.int64)
    n[n == 255] = parts["more"]
    return n


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    got = [_unpacked(k.as_py(), c.as_py()) for k, c in zip(rows.column("keys"), rows.column("counts"), strict=True)]
    return _counted(np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got]))


def _positions(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, least_count: tuple = LEAST_COUNT, discount: float = DISCOUNT, shard_tokens: int = SHARD_TOKENS, keep: bool = False) -> tuple:
    """Build the model of ``order`` 1 to 3 from the rows that aren't held out; returns what :func:`score` needs.

    The files are removed when the driver's Python ends, unless ``keep``; :func:`remove` does it at once.
    """
    return _trained(df, id_col, text_col, order, least_count, discount, shard_tokens, keep)[0]


def train_and_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, least_count: tuple = LEAST_COUNT, discount: float = DISCOUNT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """:func:`score` of all rows by a model trained on those that aren't held out; the texts are numbered once for both."""
    model, rows = _trained(df, id_col, text_col, order, least_count, discount, shard_tokens, False)
    return _scored(rows, model, id_col)


def _trained(df: DataFrame, id_col: str, text_col: str, order: int, least_count: tuple, discount: float, shard_tokens: int, keep: bool) -> tuple[tuple, DataFrame]:
    """(model, numbered rows)."""
    spark = df.sparkSession
    uri = f"{shared_dir(spark).rstrip('/')}/quillspark-lm-{uuid.uuid4().hex}"
    if not keep:
        atexit.register(remove, (uri,))
    docs = df.select(id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, -(-size // (6 * shard_tokens)))

    def words(batches):
        for batch in batches:
            keep = ~held_out(batch.column(0).to_pylist())
            for _, _, hashes, number, _ in token_groups([t for t, k in zip(text_bytes(batch, 1), keep, strict=True) if k]):
                own = np.argsort(hashes)
                h, n = hashes[own], np.bincount(number, minlength=len(hashes))[own]
                edges = np.searchsorted(_part(h, parts), np.arange(parts + 1))
                yield _rows([(int(p), *_packed(h[edges[p] : edges[p + 1]], n[edges[p] : edges[p + 1]])) for p in np.flatnonzero(np.diff(edges))])

    def vocabulary(key, rows):
        h, n = _merged(rows)
        _save(uri, f"words-{key[0].as_py()}", {"hashes": h, "counts": n.astype(np.min_scalar_type(int(n.max())))})
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": [len(h)], "total": [int(n.sum())]})

    made = docs.mapInArrow(words, _BLOB).groupBy("shard").applyInArrow(vocabulary, "shard int, n bigint, total bigint")
    sums = made.toArrow()  # one row for each part of the vocabulary, some twenty bytes
    sizes, at = np.zeros(parts, np.int64), sums.column("shard").to_numpy()
    sizes[at] = sums.column("n").to_numpy()
    for p in np.setdiff1d(np.arange(parts), at).tolist():
        _save(uri, f"words-{p}", {"hashes": np.empty(0, np.uint64), "counts": np.empty(0, np.int64)})
    _save(uri, "starts", {"starts": np.append(0, np.cumsum(sizes))})
    total = int(sums.column("total").to_numpy().sum())
    shards = max(1, -(-total // shard_tokens))
    rows = _numbered(docs, (uri, parts, shards, 1, total), id_col, text_col)
    if order >= 2:
        rows.write.option("compression", "zstd").parquet(f"{uri}/tokens")
        rows = spark.read.schema(rows.schema).parquet(f"{uri}/tokens")
        _levels(rows, (uri, parts, shards, 1, total), order, least_count, discount)
    return (uri, parts, shards, order, total), rows


_UNKNOWN = np.uint32(0xFFFFFFFF)


def _numbered(docs: DataFrame, model: tuple, id_col: str, text_col: str) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_score, tokens): ``tokens`` are the words' numbers, four bytes each."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lm = _model(model)
        n_tokens, n_known, base, tokens = [], [], [], []
        for _, _, hashes, number, sizes in token_groups(text_bytes(batch, 1)):
            word, times = lm.numbers(hashes)
            coded = np.where(word >= 0, word, _UNKNOWN).astype("<u4")[number]
            edge = np.cumsum(sizes)
            start = edge - sizes
            n_tokens.append(sizes)
            n_known.append(np.add.reduceat((times > 0)[number].astype(np.int64), start))
            base.append(np.add.reduceat(lm.unigram(times)[number], start))
            tokens += [coded[a:b].tobytes() for a, b in zip(start.tolist(), edge.tolist(), strict=True)]
        return record_batch(**{
            id_col: batch.column(0), "held_out": pa.array(held_out(batch.column(0).to_pylist())), "n_tokens": pa.array(np.concatenate(n_tokens)),
            "n_known": pa.array(np.concatenate(n_known)), "base_score": pa.array(np.concatenate(base)), "tokens": pa.array(tokens, pa.binary()),
        })

    return map_batches(docs, run, f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, tokens binary")


def _groups(tokens: pa.Array):
    """(tokens, their places in their texts, sizes) of texts together: numbers, or -1."""
    held, size = [], 0

    def group():
        all_tokens = np.concatenate(held).astype(np.int64)
        all_tokens[all_tokens == _UNKNOWN] = -1
        sizes = np.array([len(t) for t in held])
        return all_tokens, _positions(sizes), sizes

    for t in tokens:
        held.append(np.frombuffer(t.as_buffer(), "<u4"))
        size += len(held[-1])
        if size >= GROUP:
            yield group()
            held, size = [], 0
    if held:
        yield group()


def _levels(rows: DataFrame, have: tuple, order: int, least: tuple, discount: float) -> None:
    """Count, then write the levels: bigrams, and over them trigrams."""
    (uri, parts, shards), spark = have[:3], rows.sparkSession

    def grams(batches):
        model = _model(have)
        for batch in batches:
            for tokens, position, _ in _groups(batch.column(0)):
                at = np.flatnonzero(position >= 1)
                first, second = tokens[at - 1], tokens[at]
                third = np.full(len(at), model.distinct)  # stands for no word
                if order >= 3:
                    more = np.flatnonzero(np.append(position[1:], 0)[at])  # the text goes on
                    third[more] = tokens[at[more] + 1]
                yield _context_blobs(model.shard_of(first, second), model.key(first, second), third, shards)

    def merge(key, rows):
        """Keep the shard's counts, and send on how many bigrams each word begins, and their count."""
        model, s = _model(have), key[0].as_py()
        keys, at, word, n = _merged_contexts(rows)
        size = np.add.reduceat(n, _starts(at))  # no context without an n-gram
        kept = size >= least[1]
        node = np.cumsum(kept) - 1
        if order >= 3:
            goes_on = (word < model.distinct) & kept[at]
            pointers = np.append(0, np.cumsum(np.bincount(node[at[goes_on]], minlength=int(kept.sum()))))
            _save(uri, f"counts3-{s}", {"pointers": EliasFano.encode(pointers, int(pointers[-1]) + 1), "words": _squeezed(word[goes_on].astype("<u4")), **_small(n[goes_on])})
        keys, n = keys[kept], size[kept]
        _save(uri, f"counts2-{s}", {"keys": _squeezed(np.diff(keys, prepend=np.uint64(0))), **_small(n)})
        context = model.split(keys)[0]
        first = _starts(context)
        context = context[first]
        size = np.diff(np.append(first, len(keys)))
        count = np.add.reduceat(n, first) if len(first) else n
        part = np.searchsorted(model.starts, context, "right") - 1
        edges = np.searchsorted(part, np.arange(parts + 1))
        out = []
        for p in np.flatnonzero(np.diff(edges)):
            own = slice(edges[p], edges[p + 1])
            planes, sizes = _packed(context[own].astype(np.uint64), size[own])
            out.append((int(p), planes, sizes + _packed(context[own].astype(np.uint64), count[own])[1], len(sizes)))
        return pa.table({"part": pa.array([r[0] for r in out], pa.int32()), "keys": pa.array([r[1] for r in out], pa.binary()), "counts": pa.array([r[2] for r in out], pa.binary()), "at": pa.array([r[3] for r in out], pa.int32())})

    def weights(key, rows):
        """Back-off weights of the words of one part of the vocabulary."""
        model, p = _model(have), key[0].as_py()
        count = np.asarray(model.words(p)["counts"], float)
        gone = np.zeros(len(count))
        for k, c, at in zip(rows.column("keys"), rows.column("counts"), rows.column("at"), strict=True):
            c, at = c.as_py(), at.as_py()
            context, size = _unpacked(k.as_py(), c[:at])
            gone[context.astype(np.int64) - model.starts[p]] += _unpacked(k.as_py(), c[at:])[1] - discount * size  # a row's contexts are distinct
        _save_weights(uri, p, np.log10(np.maximum(1 - gone / np.maximum(count, 1), 1e-9)))
        return pa.table({"part": pa.array([p], pa.int32())})

    counted = rows.where("not held_out").select("tokens").mapInArrow(grams, _WORDS_BLOB)
    masses = counted.groupBy("shard").applyInArrow(merge, "part int, keys binary, counts binary, at int")
    done = {r[0] for r in masses.groupBy("part").applyInArrow(weights, "part int").collect()}  # one row for each part of the vocabulary
    lengths = np.diff(_mapped(uri, "starts")[0]["starts"])
    for p in set(range(parts)) - done:
        _save_weights(uri, p, np.zeros(lengths[p]))

    def bigrams(s: int, model: Model) -> dict:
        raw = _mapped(uri, f"counts2-{s}")[0]
        context, word = model.split(np.cumsum(_restored(raw["keys"]), dtype=np.uint64))
        first = _starts(context)
        size = np.diff(np.append(first, len(context)))
        own = np.repeat(model.of_words(context[first], "weight"), size)
        p = (_whole(raw) - discount) / np.repeat(np.maximum(model.of_words(context[first], "count"), 1), size)
        p += 10.0 ** (own + model.unigram(model.of_words(word, "count")))
        return Level.parts(context, word, np.log10(p), context[first], np.zeros(0))

    def trigrams(s: int, model: Model) -> dict:
        raw = _mapped(uri, f"counts3-{s}")[0]
        pointers = EliasFano(raw["pointers"])
        size = np.diff(pointers.get(np.arange(pointers.n)))
        contexts = np.flatnonzero(size)
        word, n = _restored(raw["words"]).astype(np.int64), _whole(raw)
        back = np.repeat(np.arange(len(contexts)), size[contexts])
        total = np.bincount(back, n, minlength=len(contexts))
        kept = n >= least[2]
        back, word, n = back[kept], word[kept], n[kept]
        weight = 1 - np.bincount(back, n - discount, minlength=len(contexts)) / np.maximum(total, 1)
        # the lower order: the context's last word, then this one
        last = model.level(2, s).word_of(contexts)
        middle = last[back]
        lower = model.unigram(model.of_words(word, "count")) + model.of_words(last, "weight")[back]
        _, node, p2 = model.look_up(2, model.shard_of(middle, word), middle, word)
        lower = np.where(node >= 0, p2, lower)
        p = np.log10((n - discount) / total[back] + weight[back] * 10.0**lower)
        some = np.bincount(back, minlength=len(contexts)) > 0
        return Level.parts(contexts[back], word, p, contexts[some], np.log10(weight[some]))

    for k, made in ((2, bigrams), (3, trigrams))[: order - 1]:

        def build(batches, k=k, made=made):
            model = _model((*have[:3], 2, have[4]))
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    _build(uri, k, s, lambda s=s: made(s, model))
                yield batch

        spark.range(0, shards, 1, shards).mapInArrow(build, "id bigint").count()


def _build(uri: str, k: int, s: int, made) -> None:
    """Write a shard's level, once: it is complete as soon as it has its name, and then its counts go.

    Another attempt at the same time may find no counts because the first has just dropped them. The level is
    there by then; only if it isn't has the shard no n-grams.
    """
    name = f"level{k}-{s}"
    if _there(uri, name):
        return
    if _there(uri, f"counts{k}-{s}"):
        try:
            level = made()
        except OSError:
            if not _there(uri, name):
                raise
            return
        _save(uri, name, level)
        _drop(uri, f"counts{k}-{s}")
    elif not _there(uri, name):
        _save(uri, name, Level.parts(*[np.empty(0, np.int64)] * 2, np.empty(0), np.empty(0, np.int64), np.empty(0)))


def remove(model: tuple) -> None:
    """Delete a model's files."""
    store, path = _store(model[0])
    if store.get_file_info(path).type == pafs.FileType.Directory:
        store.delete_dir(path)


def _save_weights(uri: str, part: int, log_b: np.ndarray) -> None:
    value, code = _quantised(log_b)
    _save(uri, f"backoff-{part}", {"value": value, "code": code})


def _there(uri: str, name: str) -> bool:
    store, path = _store(uri)
    return store.get_file_info(f"{path}/{name}").type == pafs.FileType.File


def _drop(uri: str, name: str) -> None:
    store, path = _store(uri)
    if _there(uri, name):
        store.delete_file(f"{path}/{name}")


def score(df: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; the scores are log10."""
    return _scored(_numbered(df.select(id_col, text_col), model, id_col, text_col), model, id_col)


def _scored(rows: DataFrame, model: tuple, id_col: str) -> DataFrame:
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lm = _model(model)
        full = [np.add.reduceat(lm.log_p(tokens, position), np.cumsum(sizes) - sizes) for tokens, position, sizes in _groups(batch.column(5))]
        own = {c: batch.column(i) for i, c in enumerate((id_col, "held_out", "n_tokens", "n_known"))}
        return record_batch(**own, train_tokens=pa.array(np.full(batch.num_rows, lm.total)), base_score=batch.column(4), score=pa.array(np.concatenate(full)))

    return map_batches(rows, run, f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
