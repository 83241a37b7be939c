"""BPE encoding and decoding with a public vocabulary file.

Texts are split into stretches without white space; what isn't known of these is cut into words, and words of up to SHORT
symbols are merged by rank side by side, as arrays. Longer ones backtrack over Aho-Corasick matches, from a word's end: at
each place the longest token that ends there is taken if it is compatible with the token after it, else a shorter one, else
the token after is taken back. Two tokens are compatible if merging the text of both gives just these two; a chain of
pairwise compatible tokens is what merging by rank gives, and a place found to lead nowhere isn't tried again, so the work
is linear in the text. Decoding gathers bytes through an offset table.

Results for odd input: null or empty texts give no ids and an empty decoded text; a null doc_id stays null; repeated
rows give repeated results; a text of any length is encoded whole; of equal pairs that overlap the leftmost is merged, as
the library does; other columns of the input are left aside.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import BATCH_BYTES, slices, whole_docs

#: Entries that a worker keeps of stretches already encoded; when full, they become the older half, which then goes.
CACHE = 250_000
#: Longer stretches aren't kept.
LONGEST_KEPT = 64
#: Words of at most so many symbols are merged side by side, PACE of them at once: a round merges one pair of each.
SHORT, PACE = 64, 4096
#: Different stretches that are looked up at once.
RUN = 1 << 17
#: Stands for the rank of a pair that isn't merged. Ranks are multiplied by SHORT, so that a pair's place can be added.
UNMERGED = 1 << 30
END = "￿"  # stands for the end of a word within the tables below
#: Begins the stretches that are special tokens; as a capital letter it is in no other.
MARK = "S"
NEVER = 1 << 60
LONGEST, FAIL = "longest", "fail"
# White space as the vocabulary's regular expressions know it.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file (BPE with word ends, lower case)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        own = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        self.ids = {own(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        merged = []
        for r, (a, b) in enumerate(model["merges"]):
            pair = self.ids[own(a)], self.ids[own(b)]
            self.rank[pair] = r
            merged.append(self.ids[own(a + b)])
            self.parts.setdefault(merged[-1], (r, *pair))
        self._pair_table(merged)
        self.root: dict | None = None
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        symbols = byte_symbols()
        self.to_symbols = {b: s for b, s in enumerate(symbols)}
        word = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"
        self.find = regex.compile(word).findall
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        # the offset table: the bytes of all tokens, each after a blank
        strings = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        pieces = [(" " + strings.get(i, "")).encode() for i in range(max(strings) + 1)]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)

    def _pair_table(self, merged: list[int]) -> None:
        """Pairs of tokens and their ranks in an open-addressed table; the token of each symbol within and at the end of a word."""
        self.merged = np.array(merged, np.int64)
        self.blank = max(self.ids.values(), default=0) + 1  # no token: what stands around a word
        bits = (4 * len(self.rank)).bit_length()
        self.slots, self.slot_ranks, self.shift = np.full(1 << bits, -1, np.int64), np.full(1 << bits, UNMERGED, np.int32), 64 - bits
        keys = np.array([a * (self.blank + 1) + b for a, b in self.rank], np.int64)
        ranks, at = np.array([*self.rank.values()], np.int32) * SHORT, self._slot(keys)
        while len(keys):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[free]  # of those that meet in a slot the last stays
            placed = self.slots[at] == keys
            self.slot_ranks[at[placed]] = ranks[placed]
            keys, ranks, at = keys[~placed], ranks[~placed], at[~placed] + 1 & len(self.slots) - 1
        symbols = [chr(c) for c in range(512)]
        self.within, self.at_end = (np.array([self.ids.get(c + end, -1) for c in symbols], np.int64) for end in ("", END))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * (self.blank + 1) + right
        at = self._slot(keys)
        found = self.slots[at]
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at[rest] = at[rest] + 1 & len(self.slots) - 1
            found = self.slots[at[rest]]
            rest = rest[(found != keys[rest]) & (found >= 0)]
        return self.slot_ranks[at]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words of 1 to SHORT symbols each, as 32-bit integers: the pair of the least rank is merged, of equals the leftmost, until none is left."""
        out, lengths = [b""] * len(words), np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for first in range(0, len(order), PACE):
            sizes, block = lengths[order[first : first + PACE]], order[first : first + PACE].tolist()
            n = len(block)
            symbols, ends, depth = np.frombuffer("".join([words[i] for i in block]).encode("utf-16-le"), np.uint16), np.cumsum(sizes), int(sizes[-1])
            # a word is a column, with blanks below it; as places are counted row by row, that before the first row is one of the last
            tokens = np.full((depth + 1) * n, self.blank, np.int64)
            tokens[(np.arange(len(symbols)) - np.repeat(ends - sizes, sizes)) * n + np.repeat(np.arange(n), sizes)] = self.within[symbols]
            tokens[(sizes - 1) * n + np.arange(n)] = self.at_end[symbols[ends - 1]]
            if tokens.min() < 0:
                raise ValueError("a symbol has no token")
            row = np.repeat(np.arange(depth + 1, dtype=np.int32), n)
            ranks = np.append(self._ranks(tokens[:-n], tokens[n:]), np.full(n, UNMERGED, np.int32)) | row
            before, after = np.arange(len(tokens)) - n, np.arange(len(tokens)) + n
            while True:
                best = ranks.reshape(depth + 1, n).min(axis=0)
                columns = np.flatnonzero(best < UNMERGED)
                if not len(columns):
                    break
                best = best[columns]
                a = best % SHORT * n + columns
                b, left = after[a], before[a]
                right, new = after[b], self.merged[best // SHORT]
                tokens[a], tokens[b], ranks[b] = new, -1, UNMERGED
                after[a], before[right] = right, a
                found = self._ranks(np.append(tokens[left], new), np.append(new, tokens[right]))
                ranks[left], ranks[a] = found[: len(a)] | row[left], found[len(a) :] | row[a]
            tokens = tokens.reshape(depth + 1, n).T
            kept = (tokens >= 0) & (tokens != self.blank)
            ids, stops = tokens[kept].astype(np.int32).tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
            for i, start, stop in zip(block, [0, *stops], stops):
                out[i] = ids[start:stop]
        return out

    def _spines(self, parts: dict) -> None:
        """For each token the symbols at its right and left edge while it is built, with the rank that ends each."""
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for i in self.ids.values():
            for spine, side in ((self.right, 2), (self.left, 1)):
                at, ends, out = i, NEVER, []
                while True:
                    out.append((at, ends))
                    if at not in parts:
                        break
                    ends, at = parts[at][0], parts[at][side]
                spine[i] = out

    def _safe(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge of a rank below `before` joins the edges of a and b while these are being built.

        Of equal pairs that overlap the leftmost is merged first, hence the two comparisons.
        """
        for x, x_ends in self.right[a]:
            for y, y_ends in self.left[b]:
                m = self.rank.get((x, y), NEVER)
                if m < x_ends and m <= y_ends and m < before:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) > 2 * CACHE:
            self.pairs.clear()
        fits = self.pairs[a << 16 | b] = self._safe(a, b)
        return fits

    def _automaton(self) -> None:
        """The Aho-Corasick automaton of all tokens that merging can give: a state maps symbols to states, LONGEST to its longest token that ends there."""
        parts = self.parts
        self._spines(parts)
        made = {t: i for t, i in self.ids.items() if i not in parts or self._safe(parts[i][1], parts[i][2], parts[i][0])}
        self.length = {i: len(t) for t, i in made.items()}
        self.shorter = {i: next((made[t[k:]] for k in range(1, len(t)) if t[k:] in made), -1) for t, i in made.items()}
        self.root = {LONGEST: -1}
        levels: list[list[tuple[dict, str, dict]]] = []
        for t, i in made.items():
            at = self.root
            for depth, ch in enumerate(t):
                to = at.get(ch)
                if to is None:
                    to = at[ch] = {LONGEST: -1}
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((at, ch, to))
                at = to
            at[LONGEST] = i
        for level in levels:
            for parent, ch, at in level:
                at[FAIL] = self.root if parent is self.root else self._follow(parent[FAIL], ch)
                if at[LONGEST] < 0:
                    at[LONGEST] = at[FAIL][LONGEST]
        self.learnt: list[tuple[dict, str]] = []

    def _follow(self, at: dict, ch: str) -> dict:
        while True:
            to = at.get(ch)
            if to is not None or at is self.root:
                return to if to is not None else at
            at = at[FAIL]

    def _learn(self, at: dict, ch: str) -> dict:
        """The step over failure links, kept for the next time."""
        if len(self.learnt) > 4 * CACHE:
            for state, symbol in self.learnt:
                del state[symbol]
            self.learnt.clear()
        to = at[ch] = self._follow(at, ch)
        self.learnt.append((at, ch))
        return to

    def word(self, word: str) -> list[int]:
        """Ids of one word (symbols of its bytes, then END), found from its end."""
        if self.root is None:
            self._automaton()
        at, learn = self.root, self._learn
        ends = [-1, *[(at := at.get(ch) or learn(at, ch))[LONGEST] for ch in word]]
        left = len(word)
        token, out, dead = ends[left], [], set()
        length, shorter, pairs, after = self.length, self.shorter, self.pairs, None
        while left:
            if token >= 0:
                start = left - length[token]
                if start in dead:
                    token = shorter[token]
                    continue
                if after is not None:
                    fits = pairs.get(token << 16 | after)
                    if not (self.compatible(token, after) if fits is None else fits):
                        token = shorter[token]
                        continue
                out.append(token)
                after, left, token = token, start, ends[start]
            else:
                dead.add(left)
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                token = out.pop()
                after = out[-1] if out else None
                left += length[token]
        out.reverse()
        return out

    def _learn_chunks(self, chunks: list[str]) -> None:
        """Keep the ids of stretches without white space, as 32-bit integers."""
        if len(self.chunks) > CACHE:
            self.older, self.chunks = self.chunks, {}
        known, older = self.chunks, self.older
        cut: list[tuple[str, list[str]]] = []
        words: dict[str, bytes] = {}
        for c in chunks:
            if (ids := older.get(c)) is not None:
                known[c] = ids
            elif c.isalpha():
                words[c] = b""
            elif c[:1] == MARK:
                known[c] = array("i", [self.special[c[1:]]]).tobytes()
            else:
                # a word and one sign are two pieces
                cut.append((c, pieces := [c[:-1], c[-1]] if c[:-1].isalpha() else self.find(c)))
                for w in pieces:
                    words[w] = b""
        for w in words:
            words[w] = known.get(w) or older.get(w) or b""
        asked = [w for w, ids in words.items() if not ids]
        spelt = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.to_symbols) for w in asked]
        short = [i for i, w in enumerate(spelt) if len(w) <= SHORT]
        words.update(zip([asked[i] for i in short], self.words([spelt[i] for i in short])))
        words.update((w, array("i", self.word(s + END)).tobytes()) for w, s in zip(asked, spelt) if len(s) > SHORT)
        known.update(words)
        known.update((c, b"".join([words[w] for w in pieces])) for c, pieces in cut)

    def _odd(self, text: str) -> str:
        """A text in lower case with single blanks between its stretches; special tokens stand alone, after MARK."""
        out: list[str] = []
        for part in self.split_special(text) if self.split_special and "<|" in text else (text,):
            if part in self.special:
                out.append(MARK + part)
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += part.split() if not CONTROL(part) else re.split(f"[{SPACE}]+", part)
        return " ".join(out)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after another, and where each text's begin and the last one's end."""
        texts = pc.fill_null(column, "")
        lowered, odd = pc.ascii_lower(texts), pc.or_(pc.invert(pc.string_is_ascii(texts)), pc.match_substring(texts, "<|"))
        if odd.true_count:
            lowered = pc.replace_with_mask(lowered, odd, pa.array([self._odd(t) for t in texts.filter(odd).to_pylist()], texts.type))
        split = pc.ascii_split_whitespace(lowered)
        stretches = split.flatten().dictionary_encode()
        found: list[bytes] = []
        for first in range(0, len(stretches.dictionary), RUN):
            run = stretches.dictionary[first : first + RUN].to_numpy(zero_copy_only=False).tolist()
            ids = [*map(self.chunks.get, run)]
            missing = [i for i, x in enumerate(ids) if x is None]
            self._learn_chunks([run[i] for i in missing])
            for i in missing:
                ids[i] = self.chunks[run[i]]
                if len(run[i]) > LONGEST_KEPT:
                    del self.chunks[run[i]]
            found += ids
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, which = np.cumsum(sizes) - sizes, stretches.indices.to_numpy()
        counts = sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(starts[which] - ends[:-1], counts) + np.arange(ends[-1])
        return np.frombuffer(b"".join(found), np.int32)[at], ends[split.offsets.to_numpy() - split.offsets[0].as_py()]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings joined by blanks, as UTF-8."""
        if not len(ids):
            return b""
        starts = self.offsets[ids]
        sizes = self.offsets[1:][ids] - starts
        ends = np.cumsum(sizes)
        return self.blob[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()[1:]


#: What Python splits at, but the vocabulary's expressions don't.
CONTROL = re.compile("[\x1c-\x1f]").search


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def lists(rows: list[np.ndarray | list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array of int) of every text of `docs`; vocabulary: the file's path, the same on all machines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                ids, ends = c.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return whole_docs(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """tokens (doc_id, ids) with the decoded text beside; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for part in slices(batch, "ids"):
                ids = part.column("ids")
                out = [c.decode(row.values.to_numpy() if row.is_valid else ()) for row in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array([x.decode() for x in out], pa.string())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per text: number and digest of its ids, digest of the decoded text."""
    return decode(encode(docs, vocabulary), vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
