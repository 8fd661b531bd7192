"""Byte-level BPE by speculation and verification.

Greedy longest match over a trie proposes tokens for every distinct pre-token at once. A sequence of tokens is what
merging by rank gives if each token is what its own bytes merge to and each adjacent pair stays apart when merged
alone; that is tested for all pairs at once by taking tokens apart along the border. Only words that fail are merged
step by step. In a word of more than PIECE bytes the proposal begins afresh every PIECE bytes; the pairs across these
borders are tested like all others.

A tokenizer file of another kind (with a normalizer, another way of cutting, dropout and the like) is refused. Nulls and
empty texts have no tokens. Equal texts have equal ids; rows with equal or null ids are encoded each; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ragged, slices, texts

#: Bytes after which a long word's proposal begins afresh.
PIECE = 256
#: Bytes up to which words that fail are merged side by side; longer ones one by one.
TOGETHER = 64
#: Characters of the distinct words whose tokens a worker keeps.
KEPT = 8 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: How this kind of tokenizer cuts a text before merging (fixed value of the published format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE, _NEVER = np.int64(-1), np.int64(1) << 41


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary file: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Model:
    """Tables of a tokenizer file; inside, tokens are numbered by rank: bytes first, then merges in order."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._accept(spec)
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        byte = {c: b for b, c in enumerate(byte_characters())}
        self.bytes = [bytes([b]) for b in range(256)]
        self.ids = [vocab[c] for c in byte_characters()]
        number = dict(byte)
        left, right, result = [], [], []
        for a, b in merges:
            if a + b in number:  # another merge has made it before
                left.append(number[a]), right.append(number[b]), result.append(number[a + b])
                continue
            number[a + b] = len(self.bytes)
            left.append(number[a]), right.append(number[b]), result.append(number[a + b])
            self.bytes.append(bytes(byte[c] for c in a + b))
            self.ids.append(vocab[a + b])
        self.merge = {(a, b): (k, r) for k, (a, b, r) in reversed(list(enumerate(zip(left, right, result, strict=True))))}
        self.simple = len(self.bytes) == 256 + len(merges)
        self.id_of = np.array(self.ids, np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text_of = dict(zip(self.ids, self.bytes, strict=True)) | {i: t.encode() for t, i in self.special.items()}
        n = len(self.bytes)
        self.split = np.stack([np.arange(n), np.arange(n)])
        for (a, b), (_, r) in self.merge.items():
            self.split[:, r] = a, b
        keys = np.array([a << 20 | b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_result = np.append(keys[order], 1 << 62), np.append(np.array([r for _, r in self.merge.values()], np.int64)[order], 0)
        self._trie()
        self.sound = np.ones(n, bool)
        made = np.arange(256, n)
        self.sound[made] = self.apart(self.split[0][made], self.split[1][made], until=made)
        self.pattern = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = max(self.text_of) + 1
        self.text_length = np.zeros(size, np.int64)
        for i, b in self.text_of.items():
            self.text_length[i] = len(b)
        self.text_start = np.concatenate([[0], np.cumsum(self.text_length)[:-1]])
        self.text_bytes = np.frombuffer(b"".join(self.text_of.get(i, b"") for i in range(size)), np.uint8)
        self._forget()

    @staticmethod
    def _accept(spec: dict) -> None:
        """Refuse a file that asks for more than cutting by PATTERN and merging."""
        model, cut, back = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "fuse_unk", "byte_fallback") if model.get(k)]
        odd += ["normalizer"] if spec.get("normalizer") else []
        odd += ["pre_tokenizer"] if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space", True) or not cut.get("use_regex", True) else []
        odd += ["decoder"] if back.get("type") != "ByteLevel" else []
        odd += ["model"] if model.get("type", "BPE") != "BPE" else []
        odd += [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") and spec.get("normalizer")]
        if odd:
            raise ValueError(f"this tokenizer file needs what is not built: {', '.join(odd)}")

    def _trie(self) -> None:
        node_of, step, accept = {b"": 0}, {}, [-1]
        for t, text in enumerate(self.bytes):
            for k in range(1, len(text) + 1):
                if text[:k] not in node_of:
                    node_of[text[:k]] = len(accept)
                    step[node_of[text[: k - 1]] << 8 | text[k - 1]] = len(accept)
                    accept.append(-1)
            accept[node_of[text]] = t
        keys = np.array(sorted(step), np.int64)
        self.step_keys, self.step_to = np.append(keys, 1 << 62), np.append(np.array([step[k] for k in keys.tolist()], np.int64), 0)
        self.accept = np.array(accept, np.int64)
        self.first = np.array([step.get(b, 0) for b in range(256)])

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For pairs of tokens: merging the bytes of both leaves these two. until: that happens before this merge, which then joins them."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 40) if until is None else until.copy()
        while len(live):
            key = a[live] << 20 | b[live]
            at = np.searchsorted(self.pair_keys, key)
            joined = np.where(self.pair_keys[at] == key, self.pair_result[at], _NEVER)
            bad = joined < limit[live]
            good[live[bad]] = False
            live = live[~bad]
            # undo the later of the two merges beside the border; what was made before it could have been joined instead
            x, y = a[live], b[live]
            take_left = (x > y) & (x >= 256) | (y < 256)
            leaf = (x < 256) & (y < 256)
            live, x, y, take_left = live[~leaf], x[~leaf], y[~leaf], take_left[~leaf]
            l, r = live[take_left], live[~take_left]
            limit[l], a[l] = x[take_left], self.split[1][x[take_left]]
            # on the right a join of the same rank would come first, being further left
            limit[r], b[r] = y[~take_left] + 1, self.split[0][y[~take_left]]
        return good

    def greedy(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from left to right in every word: word and token, in order."""
        word = np.arange(len(starts))
        pos, node = starts.copy(), np.zeros(len(starts), np.int64)
        token, after = np.full(len(starts), _NONE), starts.copy()
        out_word, out_token = [], []
        while len(word):
            p, inside = pos[word], pos[word] < ends[word]
            key = node[word] << 8 | body[np.minimum(p, len(body) - 1)]
            at = np.searchsorted(self.step_keys, key)
            go = inside & (self.step_keys[at] == key)
            g, to = word[go], self.step_to[at[go]]
            node[g], pos[g] = to, pos[g] + 1
            accepted = self.accept[to]
            hit = accepted >= 0
            token[g[hit]], after[g[hit]] = accepted[hit], pos[g[hit]]
            s = word[~go]
            out_word.append(s), out_token.append(token[s])
            pos[s], node[s] = after[s], 0
            word = np.concatenate([g, s[after[s] < ends[s]]])
        w, t = np.concatenate(out_word or [word]), np.concatenate(out_token or [word])
        order = np.argsort(w, kind="stable")
        return w[order], t[order]

    def merged(self, text: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals."""
        token, n = list(text), len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*m, i, a, b) for i, (a, b) in enumerate(zip(token, token[1:], strict=False)) if (m := self.merge.get((a, b)))]
        heap = [(k, i, a, b, r) for k, r, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, r = heapq.heappop(heap)
            j = after[i] if token[i] == a else -1
            if j < 0 or token[j] != b:
                continue
            token[i], token[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merge.get((token[x], token[y]))):
                    heapq.heappush(heap, (m[0], x, token[x], token[y], m[1]))
        return [t for t in token if t >= 0]

    def merged_together(self, body: np.ndarray, which: np.ndarray, ends: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words, one merge in each word at a time."""
        if not len(which):
            return which, which
        across = np.arange(width + 1)
        inside = across < lengths[which][:, None]
        token = np.where(inside, body[np.minimum((ends - lengths)[which][:, None] + across, len(body) - 1)].astype(np.int64), _NONE)
        rank = self._joined(token[:, :-1], token[:, 1:])
        live = np.arange(len(which))
        left = token.copy()
        while len(live):
            best = rank.argmin(axis=1)
            row = np.arange(len(live))
            value = rank[row, best]
            go = value < _NEVER
            left[live[~go]] = token[~go]
            live, token, rank, best, value = live[go], token[go], rank[go], best[go], value[go]
            row = np.arange(len(live))
            from_ = np.minimum(across + (across > best[:, None]), width)
            token = np.take_along_axis(token, from_, 1)
            token[:, -1] = _NONE
            token[row, best] = value
            rank = np.take_along_axis(rank, np.minimum(from_[:, :-1], width - 1), 1)
            rank[:, -1] = _NEVER
            rank[row, best] = self._joined(value, token[row, np.minimum(best + 1, width)])
            b = np.flatnonzero(best > 0)
            rank[b, best[b] - 1] = self._joined(token[b, best[b] - 1], value[b])
        w, k = np.nonzero(left >= 0)
        return which[w], left[w, k]

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a >= 0) & (b >= 0), a << 20 | b, -1)
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_result[at], _NEVER)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct words, one word after the other, and the number of each word's tokens."""
        lengths = np.array([len(w) for w in words], np.int64)
        body = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        ends = np.cumsum(lengths)
        fail = np.full(len(words), not self.simple)
        trial = np.flatnonzero(~fail & (lengths > 0))
        pieces = -(-lengths[trial] // PIECE)
        begin = np.repeat(ends[trial] - lengths[trial], pieces) + PIECE * ragged(np.zeros(len(trial), np.int64), pieces)
        w, t = self.greedy(body, begin, np.minimum(begin + PIECE, np.repeat(ends[trial], pieces)))
        w = np.repeat(trial, pieces)[w]
        fail[w[~self.sound[t]]] = True
        pair = np.flatnonzero(w[1:] == w[:-1])
        keys, back = np.unique(t[pair] << 20 | t[pair + 1], return_inverse=True)
        bad = ~self.apart(keys >> 20, keys & ((1 << 20) - 1))
        fail[w[pair[bad[back]]]] = True
        keep = ~fail[w]
        w, t = w[keep], t[keep]
        if fail.any():
            more = [(w, t)]
            for low, high in ((0, 8), (8, 12), (12, 18), (18, 30), (30, TOGETHER)):
                short = np.flatnonzero(fail & (lengths > low) & (lengths <= high)) if self.simple else lengths[:0]
                more.append(self.merged_together(body, short, ends, lengths, high))
            each = [(i, self.merged(words[i])) for i in np.flatnonzero(fail & (lengths > TOGETHER * self.simple)).tolist()]
            more += [(np.full(len(x), i), np.array(x, np.int64)) for i, x in each]
            w, t = (np.concatenate(x) for x in zip(*more, strict=True))
            order = np.argsort(w, kind="stable")
            w, t = w[order], t[order]
        return self.id_of[t] if len(t) else t.astype(np.int64), np.bincount(w.astype(np.int64), minlength=len(words))

    def cut(self, text: str) -> list[str]:
        """Pre-tokens; special tokens' strings are pre-tokens of their own."""
        if not self.marks or not self.marks.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*self.pattern.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and the number of each text's ids."""
        if self.size > KEPT:
            self._forget()
        get, put, old = self.known.get, self.known.setdefault, len(self.known)
        where, sizes = [], []
        for text in batch:
            cut = self.cut(text)
            at = np.fromiter(map(get, cut, repeat(-1)), np.int64, len(cut))
            for i in np.flatnonzero(at < 0).tolist():
                at[i] = put(cut[i], len(self.known))
            where.append(at), sizes.append(len(cut))
        new = list(islice(self.known, old, None))
        self.size += sum(map(len, new))
        ids, counts = self.encode_words([b"" if w in self.special else w.encode() for w in new])
        for w in self.special:
            if (i := get(w, -1)) >= old:
                ids = np.insert(ids, counts[: i - old].sum(), self.special[w])
                counts[i - old] = 1
        self.pool, self.counts = np.concatenate([self.pool, ids]), np.concatenate([self.counts, counts])
        starts = np.cumsum(self.counts) - self.counts
        all_words = np.concatenate(where) if where else np.zeros(0, np.int64)
        lengths = self.counts[all_words]
        out = self.pool[ragged(starts[all_words], lengths)]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        return out, np.diff(edges[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)])

    def _forget(self) -> None:
        self.known, self.size, self.pool, self.counts = {}, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all texts and the number of each text's bytes."""
        lengths = self.text_length[ids]
        body = self.text_bytes[ragged(self.text_start[ids], lengths)]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        return body.tobytes(), np.diff(edges[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)])


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


ENCODED = "doc_id long, ids array<int>, decoded string"


def _runs(batches, path):
    model = load(path)
    for batch in batches:
        for part in slices(batch, most=2 << 20):
            ids, counts = model.encode(part.column("text").to_pylist())
            body, lengths = model.decode(ids, counts)
            yield part, ids, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), body, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded of every text for the tokenizer file at path."""

    def run(batches):
        for part, ids, at, body, to in _runs(batches, path):
            decoded = [body[a:b].decode("utf-8", "replace") for a, b in zip(to, to[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return texts(docs, id_col=id_col, text_col=text_col).mapInArrow(run, ENCODED)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, made where the ids are, so that these need not be carried."""

    def run(batches):
        for part, ids, at, body, to in _runs(batches, path):
            raw, n = ids.astype("<u4").tobytes(), np.diff(at)
            whole = lambda b: b if b.isascii() else b.decode("utf-8", "replace").encode()
            a = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(at, at[1:], strict=False)]
            b = [hashlib.sha256(whole(body[x:y])).hexdigest() for x, y in zip(to, to[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col=id_col, text_col=text_col).mapInArrow(run, SCHEMA)
