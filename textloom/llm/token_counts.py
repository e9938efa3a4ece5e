"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary with merge ranks is compiled, as far as texts need it, to a deterministic transducer
whose transitions carry the change of the token count. A state stands for all prefixes that behave alike: the
longest suffix that can still grow into a piece, with, at each of its positions, the last token of the encoding up
to there and the count there. One character leads to the only token that ends at it and may follow the token
before it. A piece never goes on past a space mark that follows another character, so there every state goes where
the start state goes; a character outside the vocabulary leads to the start state.

Every text is cut into chunks. A chunk's map takes the state before it to the state behind it and the tokens between.
It is kept as its value at the start state; its value at another state comes from a walk of both, which ends where
they meet in one state, as they soon do. Maps compose, and a prefix scan that doubles its reach composes the maps of
all chunks; the last prefix has the text's count.

Null and empty texts have no bytes and no tokens. A text of any length is counted whole. Repeated rows and rows
with a null id are kept, one output row each; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_characters_of, kept

MARK = "▁"
START = ("", (None,), (0,))


@dataclass(frozen=True)
class ChunkMap:
    """What a run of characters does to states: `end` and `count` for the start state. The characters are those of
    `text`, or those of `parts`, two maps one after the other."""

    end: tuple
    count: int
    text: str = ""
    parts: tuple["ChunkMap", "ChunkMap"] | None = None


class Transducer:
    """Counts the pieces of a sentencepiece BPE model with byte fallback, without running it on texts."""

    def __init__(self, ranks: dict[str, float], states: int = 300_000):
        self.ranks = ranks
        self.prefixes = {p[:i] for p in ranks for i in range(1, len(p))} | {""}
        self.most_states = states
        self.parted = MARK in self.prefixes and not any(re.search(f"[^{MARK}]{MARK}", piece) for piece in ranks)
        self.follows: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.reset()

    @classmethod
    def from_model(cls, path: str, **limits) -> "Transducer":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        return cls({model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not special(i)}, **limits)

    def reset(self) -> None:
        """Forget compiled transitions; they are compiled anew when needed."""
        self.nodes: dict[tuple, dict] = {}
        self.start = self._node(START)

    def _node(self, state: tuple) -> dict:
        node = self.nodes.get(state)
        if node is None:
            node = self.nodes[state] = {None: state}
        return node

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges by rank; used at compile time on single tokens and pairs of tokens."""
        parts, ranks = list(text), self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank > best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _token(self, text: str) -> bool:
        known = self.whole.get(text)
        if known is None:
            known = self.whole[text] = text in self.ranks and self.merged(text) == [text]
        return known

    def _may_follow(self, before: str | None, token: str) -> bool:
        if before is None:
            return True
        known = self.follows.get((before, token))
        if known is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            known = self.follows[before, token] = self.merged(before + token) == [before, token]
        return known

    def _transition(self, node: dict, char: str) -> tuple[int, dict]:
        suffix, last, count = node[None]
        if char == MARK and self.parted and node is not self.start and suffix[-1:] != MARK:
            made = self.start.get(MARK) or self._transition(self.start, MARK)
        elif char not in self.ranks:
            made = len(char.encode("utf-8", "surrogatepass")), self.start
        else:
            grown = suffix + char
            at = next(i for i in range(len(grown)) if self._token(grown[i:]) and self._may_follow(last[i], grown[i:]))
            emitted = count[at] + 1
            cut = next(i for i in range(len(grown) + 1) if grown[i:] in self.prefixes)
            last = (*last, grown[at:])[cut:]
            count = (*(c - emitted for c in count), 0)[cut:]
            made = emitted, self._node((grown[cut:], last, count))
        node[char] = made
        return made

    def chunk_map(self, text: str) -> ChunkMap:
        if len(self.nodes) > self.most_states:
            self.reset()
        node, total = self.start, 0
        for char in text:
            try:
                emitted, node = node[char]
            except KeyError:
                emitted, node = self._transition(node, char)
            total += emitted
        return ChunkMap(node[None], total, text)

    def apply(self, chunk: ChunkMap, state: tuple) -> tuple[tuple, int]:
        """The state that `state` is taken to, and the tokens on the way."""
        if state == START:
            return chunk.end, chunk.count
        if chunk.parts:
            first, second = chunk.parts
            end, count = self.apply(first, state)
            if end == first.end:
                return chunk.end, count + chunk.count - first.count
            end, more = self.apply(second, end)
            return end, count + more
        if len(self.nodes) > self.most_states:
            self.reset()
        here, other, more = self.start, self._node(state), chunk.count
        for char in chunk.text:
            a, here = here.get(char) or self._transition(here, char)
            b, other = other.get(char) or self._transition(other, char)
            more += b - a
            if here is other:
                return chunk.end, more
        return other[None], more

    def compose(self, first: ChunkMap, second: ChunkMap) -> ChunkMap:
        end, count = self.apply(second, first.end)
        return ChunkMap(end, first.count + count, parts=(first, second))

    def prefix_scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """The maps of all prefixes, in rounds that double the number of chunks that a map covers."""
        reach = 1
        while reach < len(maps):
            maps = maps[:reach] + [self.compose(maps[i - reach], maps[i]) for i in range(reach, len(maps))]
            reach *= 2
        return maps

    def count(self, text: str | None, chunk: int = 1 << 16) -> int:
        """Pieces of a whole text as the model's library gives them, with its dummy prefix."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        return self.prefix_scan([self.chunk_map(marked[i : i + chunk]) for i in range(0, len(marked), chunk)])[-1].count


def transducer(path: str) -> Transducer:
    """One transducer a worker process and model, kept over its tasks."""
    return kept(("transducer", path), lambda: Transducer.from_model(path))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit for every row; narrow, no shuffle."""
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            texts = batch.column(1)
            tokens: list[int] = []
            for first, end in by_characters_of(texts):
                tokens += [machine.count(text) for text in texts.slice(first, end - first).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    text = F.col(text_column)
    return docs.select(F.col(id_column), text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(run, schema)
