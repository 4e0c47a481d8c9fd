"""Segmentations by merges as paths, and their max-plus transfer matrices.

A merge model joins, of all neighbours that form a piece, those of the highest
score first (of equals the leftmost). Of all segmentations of a text exactly one
has only neighbours that stay apart when the two are encoded alone, and it is
that of the merges. So the ids are the one path over character positions whose
steps are pieces and whose every two steps in a row are compatible; where no
such path is, the score is minus infinity.

The state at a cut of the text is the piece that ends there or goes over it: how
many characters it has before the cut and behind it. A chunk's matrix has the
sum of scores of the pieces that begin in it, for each state it is entered and
left in, and does not need its neighbours but for the characters within a
piece's reach. The product in the (max, +) semiring is associative.
"""

from __future__ import annotations

import functools

import numpy as np

#: SentencePiece's visible space.
SPACE = "▁"
NO = float("-inf")
#: Pairs of pieces whose compatibility a worker remembers; a bound on memory alone.
REMEMBERED = 1_000_000

State = tuple[int, int]


class Pieces:
    """The pieces of a vocabulary file of merges."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        self.scores = np.array([sp.get_score(i) for i in range(n)])
        self.byte_ids = [0] * 256
        text, self.ids = [b""] * n, {}
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                text[i] = bytes([int(name[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[name] = i
                text[i] = name.replace(SPACE, " ").encode()
        self.most = max(map(len, self.ids))
        #: All beginnings of pieces: where none begins, the search for longer ones ends.
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        #: Whether no piece goes over a space mark that follows another character.
        self.spaces_cut = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._lengths = np.array(list(map(len, text)))
        self._starts, self._blob = np.cumsum(self._lengths) - self._lengths, np.frombuffer(b"".join(text), np.uint8)
        self._apart: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """`text` by merges: pieces, and characters that are none."""
        parts = list(text)
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether two pieces in a row stay apart; a text begins with nothing on its left."""
        key = (left, right)
        if key not in self._apart:
            if len(self._apart) > REMEMBERED:
                self._apart.clear()
            self._apart[key] = self.merged(left + right) == ([left, right] if left else [right])
        return self._apart[key]

    def steps(self, text: str, i: int) -> list[str]:
        """Pieces that may start at i, or the character there if it is none."""
        out = []
        for length in range(1, min(self.most, len(text) - i) + 1):
            part = text[i : i + length]
            if part not in self.prefixes:
                break
            if part in self.ids and self.compatible("", part):
                out.append(part)
        if not out or len(out[0]) != 1:
            out.insert(0, text[i])
        return out

    def ids_of(self, part: str) -> list[int]:
        hit = self.ids.get(part)
        return [self.byte_ids[b] for b in part.encode()] if hit is None else [hit]

    def score(self, part: str) -> float:
        return float(sum(self.scores[i] for i in self.ids_of(part)))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids one after the other, and where those of each id begin, and all end."""
        lengths = self._lengths[ids]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return self._blob[np.repeat(self._starts[ids] - ends[:-1], lengths) + np.arange(ends[-1])], ends

    # --- the scan -----------------------------------------------------------------

    def states(self, behind: str, ahead: str) -> list[State]:
        """The states a cut may be in, by the characters on both sides."""
        if not behind:
            return [(0, 0)]
        out = []
        for i in range(1, min(self.most, len(behind)) + 1):
            for j in range(min(self.most - i, len(ahead)) + 1):
                part = behind[-i:] + ahead[:j]
                if part in self.ids and self.compatible("", part) or (i, j) == (1, 0):
                    out.append((i, j))
        return out

    def certain(self, body: str, behind: str) -> tuple[int, int] | None:
        """First place in a chunk that no piece goes over, beyond the reach of what enters, and the last one."""
        if not self.spaces_cut:
            return None
        first = next((k for k in range(self.most, len(body)) if body[k] == SPACE != body[k - 1]), None)
        last = next((k for k in range(len(body) - 1, 0, -1) if body[k] == SPACE != body[k - 1]), None)
        return None if first is None or first > last else (first, last)

    def _walk(self, body: str, ahead: str, begin: list[tuple[int, str, np.ndarray]]) -> dict[State, np.ndarray]:
        """Best scores at each state in which `body` is left; begin: (place, last piece, scores)."""
        n, text, at, out = len(body), body + ahead, [dict() for _ in range(len(body))], {}

        def reach(place: int, part: str, scores: np.ndarray) -> None:
            to, key = (out, (len(part) - place + n, place - n)) if place >= n else (at[place], part)
            to[key] = np.maximum(to[key], scores) if key in to else scores

        for b in begin:
            reach(*b)
        for p in range(n):
            if at[p]:
                for part in self.steps(text, p):
                    value = self.score(part)
                    for last, scores in at[p].items():
                        if self.compatible(last, part):
                            reach(p + len(part), part, scores + value)
            at[p] = {}
        return out

    def _entered(self, behind: str, body: str, ahead: str, states: list[State]) -> list[tuple[int, str, np.ndarray]]:
        rows = np.where(np.eye(len(states), dtype=bool), 0.0, NO)
        return [(j, behind[len(behind) - i :] + (body + ahead)[:j], row) for (i, j), row in zip(states, rows)]

    def transfer(self, behind: str, body: str, ahead: str) -> np.ndarray:
        """Scores from every state before `body` (rows) to every state behind it (columns)."""
        enter, leave = self.states(behind, body + ahead), self.states(behind + body, ahead)
        sure = self.certain(body, behind)
        if sure is None:
            end = self._walk(body, ahead, self._entered(behind, body, ahead, enter))
            none = np.full(len(enter), NO)
            return np.column_stack([end.get(s, none) for s in leave])
        a, b = sure
        none = np.full(len(enter), NO)
        head = np.maximum.reduce([none, *(v for (_, j), v in self._walk(body[:a], "", self._entered(behind, body[:a], "", enter)).items() if j == 0)])
        tail = self._walk(body[b:], ahead, [(0, "", np.zeros(1))])
        middle = float(self.scores[self.words(body[a:b])].sum())
        last = np.array([tail[s][0] if s in tail else NO for s in leave])
        return (head[:, None] + middle) + last[None, :]

    def words(self, marked: str) -> np.ndarray:
        """Ids of text that begins and ends at certain cuts, by the library."""
        if marked in ("", SPACE):  # a lone mark, which the library would not put
            return np.array([k for p in marked for k in self.ids_of(p)], np.int64)
        return np.array(self.library.encode(marked[1:].replace(SPACE, " ")), np.int64)

    def _path(self, body: str, ahead: str, place: int, last: str, leave: State | None) -> list[str]:
        """The pieces of the one way from a last piece at a place to a state behind `body`; null: any that ends there."""
        n, text = len(body), body + ahead
        came: list[dict[str, tuple[int, str] | None]] = [{} for _ in range(n + self.most + 1)]
        came[place][last] = None
        score: dict[tuple[int, str], float] = {(place, last): 0.0}
        for p in range(place, n):
            if came[p]:
                for part in self.steps(text, p):
                    for left in came[p]:
                        if self.compatible(left, part):
                            q, value = p + len(part), score[p, left] + self.score(part)
                            if value > score.get((q, part), NO):
                                came[q][part], score[q, part] = (p, left), value
        ends = [(q, part) for q in range(n, len(came)) for part in came[q] if (q == n if leave is None else (len(part) - q + n, q - n) == leave)]
        at: tuple[int, str] | None = max(ends, key=score.__getitem__)
        out = []
        while at is not None and came[at[0]][at[1]] is not None:
            out.append(at[1])
            at = came[at[0]][at[1]]
        return out[::-1]

    def trace(self, behind: str, body: str, ahead: str, enter: State, leave: State) -> np.ndarray:
        """Ids of the pieces that begin in the chunk, with both its states given."""
        i, j = enter
        last = behind[len(behind) - i :] + (body + ahead)[:j]
        if j >= len(body):
            return np.empty(0, np.int64)
        flat = lambda parts: np.array([k for p in parts for k in self.ids_of(p)], np.int64)
        sure = self.certain(body, behind)
        if sure is None:
            return flat(self._path(body, ahead, j, last, leave))
        a, b = sure
        return np.concatenate((flat(self._path(body[:a], "", j, last, None)), self.words(body[a:b]), flat(self._path(body[b:], ahead, 0, "", leave))))


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices."""
    return (left[:, :, None] + right[None, :, :]).max(axis=1)


def boundary_states(matrices: list[np.ndarray]) -> tuple[float, list[int]]:
    """Score of the one path and the number of its state at each of the len + 1 cuts.

    Prefixes are combined by doubling, as a parallel scan does.
    """
    prefix, step = list(matrices), 1
    while step < len(prefix):
        prefix = [combine(prefix[i - step], m) if i >= step else m for i, m in enumerate(prefix)]
        step *= 2
    last = int(np.argmax(prefix[-1][0]))
    states = [last]
    for i in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(prefix[i - 1][0] + matrices[i][:, states[-1]])))
    return float(prefix[-1][0, last]), [0, *states[::-1]]


@functools.lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    return Pieces(model)
