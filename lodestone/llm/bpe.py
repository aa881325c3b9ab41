"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton and backtracking (operator 10).

Bytes map to Latin-1 characters, so that pyahocorasick, which works on str, sees one character a byte.
A pre-token's encoding is the only sequence of vocabulary tokens in which every adjacent pair is
compatible, i.e. merging their joined bytes gives just these two tokens. So the encoder takes the longest
token at each position, keeps it if it is compatible with the one before, else tries the next shorter
one, and steps back when none is left; a position that was left once is never tried again, which keeps the
work linear. Pair decisions are memoised. Nothing is kept for a place but a byte, so long pre-tokens need little memory.
Short pre-tokens that no memo knows pass the automaton together, joined by a character that no token has;
one that meets an incompatible pair steps back from there.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from lodestone.llm.common import map_texts

#: Token ids in half a worker's memo of pre-tokens, pairs in half that of pairs; a full half becomes the older one. Only speed depends on them.
WORD_MEMO, PAIR_MEMO = 750_000, 250_000
#: Longest pre-token, in characters, that is memoised and passes the automaton with others, and most pre-tokens looked up at once.
SHORT, AT_ONCE = 64, 16_384
#: Not a Latin-1 character, so no token goes across it.
BORDER = "\u0100"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Parse a rank file: base64 token, blank, rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Codec:
    """Exact byte-pair encoding by ranks; every single byte must be a token."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = read_ranks(raw)
        self.tokens: dict[int, bytes] = {r: t for t, r in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        # a node's children are searched in the order they came: by rank, single bytes last, the frequent ones are first
        for t in sorted(self.ranks, key=lambda t: (len(t) == 1, self.ranks[t])):
            self.automaton.add_word(t.decode("latin-1"), self.ranks[t])
        self.automaton.make_automaton()
        self.leads = {t.decode("latin-1"): r for t, r in self.ranks.items()}  # and beginnings of tokens, once met, with their longest token
        self.size = {r: len(t) for t, r in self.ranks.items()}
        self.most = max(map(len, self.ranks))
        self.prefixes: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, int] = {}
        self.older_pairs: dict[int, int] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a single byte gives itself twice."""
        if (known := self.parts.get(token)) is not None:
            return known
        pieces = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
        while len(pieces) > 2:
            best = min(range(len(pieces) - 1), key=lambda i: (self.ranks.get(pieces[i] + pieces[i + 1], 1 << 60), i))
            pieces[best : best + 2] = [pieces[best] + pieces[best + 1]]
        out = self.parts[token] = (self.ranks[pieces[0]], self.ranks[pieces[-1]])
        return out

    def fit(self, left: int, right: int) -> int:
        """The longest of a token and its beginnings that may follow `left`, or -1.

        Two tokens may follow each other if encoding their joined bytes gives these two again.
        """
        known, keys = right, []
        while True:
            keys.append(left << 32 | known)
            if (met := self.pairs.get(keys[-1], self.older_pairs.get(keys[-1]))) is not None:
                known = met
            elif not self._undo(left, known):
                known = self.shorter(known)
                if known >= 0:
                    continue
            break
        for key in keys:
            if len(self.pairs) >= PAIR_MEMO:
                self.older_pairs, self.pairs = self.pairs, {}
            self.pairs[key] = known
        return known

    def _undo(self, left: int, right: int) -> bool:
        # Undo merges from the latest; a merge across the border that would have come earlier than those
        # still standing on both sides shows that the pair can't occur.
        bound = 1 << 60
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < bound:
                return False
            for _ in range(2):
                if left > right:
                    bound, half = left, self.halves(left)[1]
                    stuck, left = half == left, half
                else:
                    bound, half = right + 1, self.halves(right)[0]
                    stuck, right = half == right, half
                if not stuck:
                    break
                # the larger side is a single byte: undo the other one
                if len(self.tokens[left]) == 1 and len(self.tokens[right]) == 1:
                    return True
                if len(self.tokens[left]) > 1:
                    bound, left = left, self.halves(left)[1]
                else:
                    bound, right = right + 1, self.halves(right)[0]
                break

    def word(self, piece: str) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        raw = piece.encode()
        if (whole := self.ranks.get(raw)) is not None:
            return (whole,)
        chars = raw.decode("latin-1")
        return self._backtrack(chars, [], 0, self.longest(chars, 0)) if chars else ()

    def short_words(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Token ids of each pre-token; none may be empty."""
        known, done = self.pairs.get, []
        every = [p.encode().decode("latin-1") for p in pieces]
        longest_first = self.automaton.iter_long(BORDER.join(every))
        end = -1
        for chars in every:
            start, end = end + 1, end + len(chars)
            at, r = next(longest_first)
            out = [r]
            while at < end:
                last = r
                at, r = next(longest_first)
                if (fits := known(last << 32 | r)) is None:
                    fits = self.fit(last, r)
                if fits != r:
                    here = at + 1 - self.size[r] - start
                    while at < end:
                        at, _ = next(longest_first)
                    out = self._backtrack(chars, out, here, fits)
                    break
                out.append(r)
            done.append(tuple(out))
            end += 1
        return done

    def longest(self, chars: str, at: int) -> int:
        """The longest token that begins at a place."""
        rest = chars[at : at + self.most]
        lead = rest[: self.automaton.longest_prefix(rest)]
        if (known := self.leads.get(lead)) is None:  # the way to a longer token need not be one itself
            shorter = lead[:-1]
            while (known := self.leads.get(shorter)) is None:
                shorter = shorter[:-1]
            self.leads[lead] = known
        return known

    def shorter(self, token: int) -> int:
        """The longest token that another one begins with, or -1."""
        if (known := self.prefixes.get(token)) is None:
            raw, known = self.tokens[token], -1
            for k in range(len(raw) - 1, 0, -1):
                if (known := self.ranks.get(raw[:k], -1)) >= 0:
                    break
            self.prefixes[token] = known
        return known

    def _backtrack(self, chars: str, out: list[int], at: int, r: int) -> tuple[int, ...]:
        """Token ids of a pre-token that begins with `out`, `at` bytes by the longest tokens; r: the longest that may follow, or -1."""
        n, most, size, known, fit = len(chars), self.most, self.size, self.pairs.get, self.fit
        reach, lead = self.automaton.longest_prefix, self.leads.get
        left_once = bytearray(n + 1)
        while at < n:
            while r >= 0 and left_once[at + size[r]]:
                r = self.shorter(r)
                if out and r >= 0:
                    r = fit(out[-1], r)
            if r >= 0:
                out.append(r)
                at += size[r]
                if at < n:
                    rest = chars[at : at + most]
                    if (longest := lead(rest[: reach(rest)])) is None:
                        longest = self.longest(chars, at)
                    last = r
                    if (r := known(last << 32 | longest)) is None:
                        r = fit(last, longest)
            else:
                left_once[at] = 1
                r = out.pop()  # it leads to a place that was left, so a shorter one comes next
                at -= size[r]
        return tuple(out)

    def _learn(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """Token ids of pre-tokens that the newer half of the memo lacks; the short ones enter it."""
        found, new, long = {}, [], []
        older = self.older.get
        for p in dict.fromkeys(pieces):
            if (known := older(p)) is not None:  # frequent pre-tokens come back from the older half
                found[p] = known
            else:
                (new if 0 < len(p) <= SHORT else long).append(p)
        found.update(zip(new, self.short_words(new), strict=True))
        more = sum(map(len, found.values()))
        if self.held + more > WORD_MEMO:
            self.older, self.words, self.held = self.words, {}, 0
        self.words.update(found)
        self.held += more
        for p in long:
            found[p] = self.word(p)
        return found

    def encode(self, text: str) -> list[int]:
        every, ids = self.find(text), []
        for i in range(0, len(every), AT_ONCE):
            pieces = every[i : i + AT_ONCE]
            known = list(map(self.words.get, pieces))
            if unknown := [k for k, w in enumerate(known) if w is None]:
                found = self._learn([pieces[k] for k in unknown])
                for k in unknown:
                    known[k] = found[pieces[k]]
            ids.extend(chain.from_iterable(known))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(raw: bytes, pattern: str) -> Codec:
    return Codec(raw, pattern)


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Append n_tokens, ids_sha256 and decoded_sha256 (and, with ids=True, token_ids and decoded) to each row.

    Each match of `pattern` is encoded alone, without special tokens; ids are then decoded again.
    ids_sha256: hex SHA-256 of the decimal ids joined by one blank; decoded_sha256: of the decoded bytes.
    Null and empty texts: 0 tokens and the digests of nothing. Texts of any length, repeated rows, empty
    tables and further columns pass; result columns replace columns of the same name.
    The rank file (a fixed public vocabulary, under BROADCAST_BYTES) is read on the driver and broadcast.
    """
    spark: SparkSession = df.sparkSession
    with open(ranks_path, "rb") as f:
        raw = f.read()
    shared = spark.sparkContext.broadcast(raw)
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    if ids:
        fields += [StructField("token_ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())]

    def make():
        codec = _codec(shared.value, pattern)
        names = {r: str(r) for r in codec.tokens}

        def run(texts: pa.Array) -> list[pa.Array]:
            n, a, b, all_ids, all_bytes = [], [], [], [], []
            for x in texts:
                got = codec.encode(x.as_py() or "")
                back = codec.decode(got)
                n.append(len(got))
                a.append(hashlib.sha256(" ".join(map(names.__getitem__, got)).encode()).hexdigest())
                b.append(hashlib.sha256(back).hexdigest())
                if ids:
                    all_ids.append(got)
                    all_bytes.append(back)
            out = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            return out + ([pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_bytes, pa.binary())] if ids else [])

        return run

    return map_texts(df, text, StructType(fields), make, keep)
