"""BPE as a deterministic automaton over pre-split words.

Compilation walks the merge list once.  The automaton starts as one state that
loops on every base symbol; the gadget for merge (a, b) -> c copies the state that
`a` leads to, drops the copy's arc `b`, redirects `a` to the copy and gives every
state that has an arc `a` the arc `c`, which leads where `b` led.  A state is thus a
base state minus a chain of dropped arcs; chains are stored as lineages, and an arc
is looked up (and kept in the transition table) as "was any prefix symbol of the
token dropped from this state before that token was built".  A path from the start
spells a word in exactly one way, which is its BPE encoding; decoding emits the
labels of the arcs.

Defined cases: null and empty texts give no tokens and an empty decoded text; texts
of any length are encoded whole; repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from string import punctuation

import numpy as np
import regex
from pyspark.sql import DataFrame

from territoria.llm.common import TwoGenerationCache, text_udf, with_struct

_NEVER = 1 << 60
_INNER, _LAST, _NEXT = 0, 1, 2  # parts of a trie node: its tokens inside a word and at its end, the nodes behind it


def _byte_symbols() -> list[str]:
    """Printable stand-in for each byte, as byte-level BPE files use it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_NO_NODES: dict = {}


def _packed(after: dict) -> dict:
    """The nodes as tuples, those without any behind them sharing one empty table: less memory to touch a step."""
    return {ch: (node[_INNER], node[_LAST], _packed(node[_NEXT])) for ch, node in after.items()} or _NO_NODES


class MergeAutomaton:
    """States after reading a token; arcs are tokens, labelled with their text."""

    def __init__(self, vocab: dict[str, int], merges: list, word_end: str):
        self.vocab, self.word_end = vocab, word_end
        self.label = {i: s for s, i in vocab.items()}
        self.dropped_at: dict[tuple[int, int], int] = {}  # (state's token, dropped arc) -> time of the gadget
        self.built_at: dict[int, int] = {}
        self.first: dict[int, int] = {}
        self.unreached: set[int] = set()
        self.lineage: dict[int, tuple[tuple[int, int], ...]] = {}  # token -> (token whose state it continues, until when)
        for time, (left, right) in enumerate(merges):
            self._gadget(time, vocab[left], vocab[right], vocab[left + right])
        self.trie: dict[str, list] = {}
        self.width: dict[int, int] = {}
        for label, token in vocab.items():
            if token in self.unreached:
                continue
            last = label.endswith(word_end)
            spelt = label[:-len(word_end)] if last else label
            if not spelt:
                continue  # no part of a word
            after, node = self.trie, None
            for ch in spelt:
                node = after.setdefault(ch, [None, None, {}])
                after = node[_NEXT]
            node[_LAST if last else _INNER] = token
            self.width[token] = len(spelt)
        self.trie = _packed(self.trie)
        self.arcs: dict[int, bool] = {}

    def _gadget(self, time: int, a: int, b: int, c: int) -> None:
        if a in self.unreached or b in self.unreached or not self._find(a, b):
            self.unreached.add(c)  # no path reads b after a, so the merge never applies
            return
        self.lineage[c] = ((c, _NEVER), *((t, min(until, time)) for t, until in self._state(b)))
        self.dropped_at[a, b] = time
        self.built_at[c] = time
        self.first[c] = a

    def _state(self, token: int) -> tuple[tuple[int, int], ...]:
        return self.lineage.get(token) or ((token, _NEVER),)

    def has_arc(self, token: int, arc: int) -> bool:
        """Whether the state after `token` has the arc."""
        key = token << 20 | arc
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) > 500_000:
                self.arcs.clear()
            known = self.arcs[key] = self._find(token, arc)
        return known

    def _find(self, token: int, arc: int) -> bool:
        state, before, sym = self._state(token), _NEVER, arc
        while True:
            for t, until in state:
                at = self.dropped_at.get((t, sym))
                if at is not None and at < until and at <= before:
                    return False
            if sym not in self.first:
                return True
            before, sym = self.built_at[sym], self.first[sym]

    def encode(self, word: str) -> list[int]:
        """The one path that spells the word; word is in byte symbols.

        Longest arcs are tried first.  Any prefix is spelt by one path only, so a
        position from which no path goes on is dead whatever led there.
        """
        n, at, state, trie, known, width = len(word), 0, None, self.trie, self.arcs, self.width
        path: list[int] = []
        open_arcs: list[tuple[int, list[int]]] = []  # (start, arcs not tried yet) of each place on the path
        dead = set()
        while at < n:
            after, arcs = trie, []
            for ch in word[at:-1] if at < n - 1 else "":
                node = after.get(ch)
                if node is None:
                    break
                t, _, after = node
                if t is not None:
                    arcs.append(t)
            else:
                node = after.get(word[-1])
                if node is not None and node[_LAST] is not None:
                    arcs.append(node[_LAST])
            while True:
                while arcs:
                    t = arcs.pop()
                    end = at + width[t]
                    if end in dead:
                        continue
                    ok = state is None or known.get(state << 20 | t)
                    if ok or (ok is None and self.has_arc(state, t)):
                        open_arcs.append((at, arcs))
                        path.append(t)
                        at, state = end, t
                        break
                else:
                    dead.add(at)
                    path.pop()
                    at, arcs = open_arcs.pop()
                    state = path[-1] if path else None
                    continue
                break
        return path


class WordTokenizer:
    """Normalise, split into words, encode by the automaton; results of words are kept in a bounded cache."""

    #: Unicode white space, which the file's pattern \s stands for.
    SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")

    def __init__(self, path: str, cache: int = 100_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.bytes = dict(enumerate(_byte_symbols()))
        self.text = {i: str(i) for i in self.automaton.label}
        self.chunks, self.words = TwoGenerationCache(cache), TwoGenerationCache(cache)

    def _words(self, chunk: str) -> list[str]:
        """The words of a run without white space."""
        low = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")).lower()
        core = low.rstrip(punctuation)
        if core.isalpha() and max(core) < "\u0250":  # letters, then signs: nothing for the pattern to decide
            return [core, low[len(core):]] if len(core) < len(low) else [core]
        return self.split.findall(low)

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """Ids and labels (joined by a space) of a run without white space."""
        found = []
        for word in self._words(chunk):
            got = self.words.get(word)
            if got is None:
                plain = word.isascii() and word.isprintable()  # then bytes are their own symbols
                ids = self.automaton.encode(word if plain else word.encode().decode("latin-1").translate(self.bytes))
                got = " ".join([self.text[i] for i in ids]), " ".join([self.automaton.label[i] for i in ids])
                self.words.put(word, got)
            found.append(got)
        return found[0] if len(found) == 1 else (" ".join([x[0] for x in found]), " ".join([x[1] for x in found]))

    def _chunks(self, chunks: list[str]) -> list[tuple[str, str]]:
        found = list(map(self.chunks.new.get, chunks))
        if None in found:
            for i, got in enumerate(found):
                if got is None:
                    got = self.chunks.get(chunks[i])
                    if got is None:
                        got = self._chunk(chunks[i])
                        self.chunks.put(chunks[i], got)
                    found[i] = got
        return found

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of tokens, ids joined by a space, decoded text)."""
        found: list[tuple[str, str]] = []
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        for part in parts:
            if part in self.special:
                found.append((str(self.special[part]), part))
            else:
                found += self._chunks([x for x in self.SPACE.split(part) if x] if odd else part.split())
        ids = " ".join([x[0] for x in found])
        return ids.count(" ") + 1 if ids else 0, ids, " ".join([x[1] for x in found])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One compiled automaton per worker process."""
    return WordTokenizer(path)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_tokens, ids (array), decoded."""
    def run(texts: list) -> list:
        tok, out = tokenizer(path), []
        for t in texts:
            n, ids, labels = tok.encode(t or "")
            out.append({"n_tokens": n, "ids": np.array(ids.split(), np.int32), "decoded": labels})
        return out

    return with_struct(docs, text_udf(run, "struct<n_tokens: bigint, ids: array<int>, decoded: string>")(docs[text]), list(keep))


def encode_digests(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_tokens, ids_sha256, decoded_sha256: the same encoding, digested where it is made."""
    def run(texts: list) -> list:
        tok, out = tokenizer(path), []
        for t in texts:
            n, ids, labels = tok.encode(t or "")
            out.append({"n_tokens": n, "ids_sha256": hashlib.sha256(ids.encode()).hexdigest(),
                        "decoded_sha256": hashlib.sha256(labels.encode()).hexdigest()})
        return out

    return with_struct(docs, text_udf(run, "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")(docs[text]), list(keep))
