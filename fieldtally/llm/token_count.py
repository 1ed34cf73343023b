"""Token counts by a tokenizer compiled to a finite-state transducer.

Merging by rank has a local test: a row of pieces is the tokenization of its text exactly if each
two neighbours are the tokenization of theirs. So the last piece of each prefix of a text is one
piece ending there, the one that is stable after the last piece of the prefix before it. To know
it for the next character, all that counts is the longest end of the text that begins some piece,
and the last pieces and counts of the prefixes that stop inside that end: a finite state. The
transducer reads a character, goes to the next state, and emits by how many pieces the count
changes, which can be less than none. States and transitions are made when first needed.

No merge reaches over two characters that stand together in no piece (before a blank, say); there
the state is that of the second character alone, whatever came before. A chunk of text therefore
maps any state at its beginning to one at its end after a short head. These maps compose
associatively, and the chunks of a text are counted apart and joined in a scan of pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import texts

#: Characters of a chunk, and states a Python worker keeps.
CHUNK, STATES = 1 << 16, 200_000
#: Runs of characters a worker keeps the count of, and the longest kept.
RUNS, LONGEST_RUN = 400_000, 48
NEVER = 1 << 60
BLANK = "▁"
#: Where a blank follows something else.
BLANKS = re.compile(f"(?<=[^{BLANK}])(?={BLANK})")


class State(dict):
    """A state of the transducer; by character, the next state and what the transition emits."""

    __slots__ = ("machine", "end", "lasts", "counts")

    def __init__(self, machine: Transducer, end: str, lasts: tuple, counts: tuple):
        self.machine, self.end, self.lasts, self.counts = machine, end, lasts, counts

    def __missing__(self, c: str):
        self[c] = found = self.machine.transition(self, c)
        return found


class Transducer:
    """Counts the pieces of texts for a model file of the sentencepiece library, BPE kind."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        scores = sorted(set(self.score.values()), reverse=True)
        rank_of = {x: i for i, x in enumerate(scores)}
        self.rank = {p: rank_of[x] for p, x in self.score.items()}
        self.stable_pairs: dict[tuple[str, str], bool] = {}
        self.made_of: dict[str, tuple[str, str]] = {}
        self.pieces = {p for p in self.score if self.merged(p, self.made_of) == [p]}
        self.spines: dict[str, tuple[list, list] | None] = {}
        self.beginnings = {p[:n] for p in self.pieces for n in range(1, len(p))}
        self.together = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        #: What some piece can begin with, and the character it goes on with.
        self.joins = {(p[:i], p[i]) for p in self.score for i in range(1, len(p))}
        self.alike: dict[tuple[str, str], str | None] = {}
        self.alike_by: dict[tuple, str] = {}
        self.states: dict[tuple, State] = {}
        self.first = self.state("", (None,), (0,))
        self.runs = Runs(self)
        if any(p.rstrip(BLANK) and BLANK in p.lstrip(BLANK) for p in self.score):
            raise ValueError("a piece has a blank after something else")

    def merged(self, text: str, made_of: dict | None = None) -> list[str]:
        """The pieces of a short text, by merging: the best pair first, of equal ones the leftmost."""
        parts, halves = list(text), None
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            halves = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if made_of is not None and halves and len(parts) == 1:
            made_of[text] = halves
        return parts

    def spine(self, piece: str) -> tuple[list, list] | None:
        """What stands at the right and at the left edge of a piece while it is merged, and the rank that ends each.

        ``None`` for a piece that isn't put together in the order of ranks.
        """
        if piece not in self.spines:
            edges = []
            for side in (1, 0):
                edge, part, until = [], piece, NEVER
                while edge is not None:
                    edge.append((part, until))
                    if part not in self.made_of:
                        break
                    own = self.rank[part]
                    edge = edge if until > own else None
                    part, until = self.made_of[part][side], own
                edges.append(edge and edge[::-1])
            self.spines[piece] = None if None in edges else tuple(edges)
        return self.spines[piece]

    def stable(self, left: str | None, right: str) -> bool:
        """Whether two pieces stay as they are side by side; ``None`` is the beginning of the text.

        They don't if at some time what stands at the two edges merges sooner than either edge changes.
        """
        if left is None or left[-1] + right[0] not in self.together:
            return True
        found = self.stable_pairs.get((left, right))
        if found is None:
            a, b = self.spine(left), self.spine(right)
            if a is None or b is None:
                found = self.merged(left + right) == [left, right]
            else:
                found = self._stay(a[0], b[1])
            self.stable_pairs[left, right] = found
        return found

    def _stay(self, left: list, right: list) -> bool:
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.rank.get(x + y, NEVER)
            if rank < x_until and rank <= y_until and rank != NEVER:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def like(self, left: str | None, c: str) -> str | None:
        """One piece for all that are stable before the same pieces beginning with ``c``; ``None`` if before all."""
        if not left:
            return left
        found = self.alike.get((left, c), "")
        if found == "":
            spine = self.spine(left)
            found = left
            if spine is not None:
                edge = tuple((x, len(x) > 1 and self.rank[x], until) for x, until in spine[0] if (x, c) in self.joins)
                found = self.alike_by.setdefault((edge, c), left) if edge else None
            self.alike[left, c] = found
        return found

    def weight(self, piece: str) -> int:
        """Tokens of a piece: one, or its bytes where the vocabulary lacks the character."""
        return 1 if piece in self.score else len(piece.encode())

    def state(self, end: str, lasts: tuple, counts: tuple) -> State:
        """``lasts`` and ``counts`` of the prefixes that stop inside ``end``, counts against the last."""
        key = end, lasts, counts
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, *key)
        return found

    def transition(self, state: State, c: str) -> tuple[State, int]:
        before = state.end
        if before and before[-1] + c not in self.together:
            state = self.first
        elif not before and state.lasts[-1] is not None and state.lasts[-1][-1] + c not in self.together:
            state = self.first
        end, counts = state.end + c, state.counts
        lasts = (*state.lasts[:-1], self.like(state.lasts[-1], c))
        # prefixes are numbered from the one that stops before ``end``
        for i in range(len(end)):
            piece = end[i:]
            if (piece in self.pieces or len(piece) == 1) and lasts[i] != "" and self.stable(lasts[i], piece):
                break
        emitted = counts[i] + self.weight(piece)
        # prefixes after which no piece can go on any more are alike
        going = [end[i:] in self.beginnings for i in range(len(end))]
        i = going.index(True) if True in going else len(end)
        lasts = tuple(x if g else "" for x, g in zip(lasts[i:], going[i:])) + (piece,)
        counts = tuple(n - emitted if g else 0 for n, g in zip(counts[i:], going[i:])) + (0,)
        return self.state(end[i:], lasts, counts), emitted

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after ``text`` and the sum of what the transitions emit."""
        total = 0
        for c in text:
            state, emitted = state[c]
            total += emitted
        return state, total

    def chunk_map(self, chunk: str) -> tuple[str, int, State | None]:
        """A chunk as a map of states: a head to be run from the state before, then count and state after it.

        The head ends where a blank follows something else; without such a place all of the chunk
        is head. What is between two such places always starts from the same state, so its count
        is kept as one transition over the whole run of characters.
        """
        runs = BLANKS.split(chunk)
        if len(runs) == 1:
            return chunk, 0, None
        state, total = self.run(self.first, runs[-1])
        return runs[0], total + sum(map(self.runs.__getitem__, runs[1:-1])), state

    def compose(self, a: tuple[str, int, State | None], b: tuple[str, int, State | None]):
        """The map of two chunks one after the other; associative."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, total = self.run(a[2], b[0])
        return a[0], a[1] + total + b[1], state if b[2] is None else b[2]

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if len(self.states) > STATES or len(self.runs) > RUNS:  # begin anew: a worker's memory is bounded
            for kept in (self.states, self.stable_pairs, self.runs):
                kept.clear()
            self.first = self.state("", (None,), (0,))
        text = BLANK + text.replace(" ", BLANK)
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            joined = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = joined + maps[len(joined) * 2 :]
        head, total, _ = maps[0]
        return self.run(self.first, head)[1] + total


class Runs(dict):
    """Counts of runs of characters from the first state, each one transition."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, run: str) -> int:
        found = self.machine.run(self.machine.first, run)[1]
        if len(run) <= LONGEST_RUN:
            self[run] = found
        return found


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per Python worker and file."""
    return Transducer(path)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text, for the model file at ``path``.

    The file must lie at the same place on all machines. A null text is taken as empty: no bytes,
    no tokens. Very long texts are counted whole, in chunks. Repeated rows give repeated results, other columns are not looked at, and an empty
    table gives an empty one. Rows are counted where they are read, without a shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            counts = pa.array([machine.count(t) for t in texts(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], schema=schema)

    text = docs["text"].cast("string")
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select(docs["doc_id"].cast("long"), n_bytes, text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
