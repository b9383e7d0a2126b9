"""BPE encoding and decoding by a tokenization automaton.

The automaton reads a pre-split word symbol by symbol and walks arcs labelled with tokens. It is
compiled from the merge list in rank order, one *merge gadget* for each merge ``(a, b) -> c``:

* it closes the two-arc path ``a b`` (at any rank later than the merge, that path no longer
  survives in a tokenization), and
* it opens one arc ``c`` that spans the same symbols, by extending the symbol trie with the
  concatenation of both labels.

After the last gadget a state is "the arc by which it was entered", and an arc ``t`` leaves state
``s`` iff no gadget closes a path across the border of ``s`` and ``t``. For every prefix of a word
exactly one entering arc survives, so the automaton is deterministic. A full state-by-token table
would have |V|^2 cells; the cells are therefore filled when a word first needs them, by undoing
the gadgets of both arcs from the latest to the earliest, and kept in a table from then on.

Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

from attestor.llm.common import prepare

#: Fixed values of the tokenizer format: its pre-splitting pattern (white space spelled out).
_SPACE = r"\t-\r \x85\xa0  -     　"
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"
_NEVER = 1 << 60
#: Words kept with their tokens by each worker; beyond that the memory is cleared.
WORD_MEMORY = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 onwards."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    fresh = iter(range(256, 512))
    return [chr(b if b in shown else next(fresh)) for b in range(256)]


class MergeAutomaton:
    """Deterministic tokenization automaton of one BPE vocabulary with word ends."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], word_end: str, special: dict[str, int]):
        self.label = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.special = special
        self.of_byte = byte_symbols()
        self.word_end = word_end
        self.trie: list[dict[str, int]] = [{}]
        self.accepts: list[int] = [-1]
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.closed: dict[tuple[int, int], int] = {}
        self.open_cells: dict[tuple[int, int], bool] = {}
        self.spell: dict[int, tuple[str, ...]] = {}
        for c in self.of_byte:
            for symbol in (c, c + word_end):
                if symbol in vocab:
                    self._arc(vocab[symbol], (symbol,))
                    self.rank[vocab[symbol]] = -1
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        if special:
            self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        self.words = regex.compile(_WORDS)
        self.memory: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_json(cls, text: str) -> MergeAutomaton:
        """From the text of a tokenizers file with a BPE model."""
        spec = json.loads(text)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        return cls(spec["model"]["vocab"], merges, spec["model"]["end_of_word_suffix"] or "", special)

    def _arc(self, token: int, symbols: tuple[str, ...]) -> None:
        node = 0
        for s in symbols:
            down = self.trie[node].get(s)
            if down is None:
                down = self.trie[node][s] = len(self.trie)
                self.trie.append({})
                self.accepts.append(-1)
            node = down
        self.accepts[node] = token
        self.spell[token] = symbols

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        self.closed.setdefault((a, b), rank)
        if c not in self.rank:
            self.rank[c], self.parts[c] = rank, (a, b)
            self._arc(c, self.spell[a] + self.spell[b])

    def leaves(self, state: int, arc: int) -> bool:
        """May this arc leave the state that was entered by the arc ``state``?"""
        cell = self.open_cells.get((state, arc))
        if cell is None:
            cell = self.open_cells[state, arc] = self._fill(state, arc)
        return cell

    def _fill(self, left: int, right: int) -> bool:
        before = _NEVER  # only gadgets earlier than this can still close the border
        while True:
            if self.closed.get((left, right), _NEVER) < before:
                return False
            if self.rank[left] < 0 and self.rank[right] < 0:
                return True
            if self.rank[left] > self.rank[right]:
                before, left = self.rank[left], self.parts[left][1]
            else:  # on equal ranks the leftmost place merges first
                before, right = self.rank[right] + 1, self.parts[right][0]

    def walk(self, word: str) -> tuple[int, ...]:
        """Arcs of one pre-split word, by transitions of the tables."""
        symbols = [self.of_byte[b] for b in word.encode("utf-8", "surrogatepass")]
        if not symbols:
            return ()
        symbols[-1] += self.word_end
        n = len(symbols)
        entered: list[tuple[int, int] | None] = [None] * (n + 1)
        trie, accepts, cells = self.trie, self.accepts, self.open_cells
        for i in range(n):
            if i and entered[i] is None:
                continue
            state, node = entered[i][1] if i else -1, 0
            for j in range(i, n):
                node = trie[node].get(symbols[j], -1)
                if node < 0:
                    break
                token = accepts[node]
                if token >= 0 and entered[j + 1] is None:
                    if state < 0 or (cells[state, token] if (state, token) in cells else self.leaves(state, token)):
                        entered[j + 1] = (i, token)
        out, i = [], n
        while i:
            i, token = entered[i]
            out.append(token)
        return tuple(out[::-1])

    def pieces(self, text: str) -> Iterator[str | int]:
        """Pre-split words of a text in order; a special token's string is its id."""
        for k, part in enumerate(self.splitter.split(text) if self.special else [text]):
            if k % 2:
                yield self.special[part]
            elif part:
                yield from self.words.findall(_normal(part))

    def encode(self, text: str) -> list[int]:
        """Token ids of a text."""
        out: list[int] = []
        for piece in self.pieces(text):
            if isinstance(piece, int):
                out.append(piece)
                continue
            arcs = self.memory.get(piece)
            if arcs is None:
                if len(self.memory) >= WORD_MEMORY:
                    self.memory.clear()
                    self.open_cells.clear()
                arcs = self.memory[piece] = self.walk(piece)
            out += arcs
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs, as the format without a decoder joins them: by one space."""
        return " ".join(map(self.label.__getitem__, ids))


def _normal(text: str) -> str:
    """NFC, then each character's own lower case (white space is dropped by the pattern)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


_compiled: dict[str, MergeAutomaton] = {}


def automaton(spec: str) -> MergeAutomaton:
    """The automaton of a tokenizers file's text; compiled once for each worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = MergeAutomaton.from_json(spec)
    return _compiled[key]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", decode: bool = True) -> DataFrame:
    """Encode every whole text: (id, ids array<int>, decoded string).

    A null text is the empty text: no ids. Repeated rows and ids each give their own row; an empty
    table gives an empty result; other columns are not read. The vocabulary file is read on the
    driver and travels as one broadcast value of the file's size (1.7 MB), which does not grow with
    the data. Each document is one row of a batch, so memory is bounded by the longest text.
    """
    spark = prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton(spec.value)
        for batch in batches:
            ids = [machine.encode(t or "") for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "ids": ids, "decoded": [machine.decode(i) for i in ids] if decode else None})

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInPandas(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_column)
