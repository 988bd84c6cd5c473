"""A vocabulary of text pieces as an Aho-Corasick automaton over bytes, run on many words in step.

A space stands for the vocabulary's word mark (U+2581). Where two neighbouring bytes occur
in no piece, every segmentation must cut; the runs between such cuts are `units`, short and
often repeated, and each distinct unit of a chunk is worked on once.
"""

from __future__ import annotations

import pickle
from collections import deque

import numpy as np

from ._shared import cache, map_file, read_file, shared_folder, write_file

MARK = "▁"
#: What a character that is no piece costs below the least score, as the public unigram encoder has it.
UNKNOWN_PENALTY = 10.0
#: Scores at or below this mark pieces that no best segmentation uses.
NEVER = -1e8


class Vocabulary:
    """Pieces by id as bytes (a space for the mark), their scores, and the ids of single bytes."""

    def __init__(self, pieces: dict[int, bytes], scores: dict[int, float], byte_ids: dict[int, int]):
        self.pieces, self.scores, self.byte_ids = pieces, scores, byte_ids

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        """From a model file of the sentencepiece library; control pieces and those never used are left out, but for the mark alone, which gets the least other score."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores, byte_ids = {}, {}, {}
        for i in range(model.get_piece_size()):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or score <= NEVER):
                pieces[i], scores[i] = piece.replace(MARK, " ").encode(), float(score)
            elif piece == MARK:
                pieces[i], scores[i] = b" ", NEVER
        scores |= {i: min(x for x in scores.values() if x > NEVER) for i in scores if scores[i] == NEVER}
        return cls(pieces, scores, byte_ids)

    def zipf(self) -> "Vocabulary":
        """The same pieces with log probabilities by rank: a piece of rank r (by score, then id) gets 1 / (r + 1), over their sum."""
        order = sorted(self.pieces, key=lambda i: (-self.scores[i], i))
        weights = 1.0 / np.arange(1, len(order) + 1)
        logs = np.log(weights / weights.sum())
        return Vocabulary(self.pieces, dict(zip(order, logs.tolist(), strict=True)), self.byte_ids)


class Automaton:
    """goto[state, byte]; the pieces that end in a state are out[state], then more[...], longest first."""

    def __init__(self, vocabulary: Vocabulary):
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        self.ids = np.array(list(vocabulary.pieces), np.int64)
        self.lengths = np.array([len(p) for p in vocabulary.pieces.values()], np.int64)
        self.scores = np.array([vocabulary.scores[i] for i in vocabulary.pieces], np.float64)
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY if len(self.scores) else -UNKNOWN_PENALTY
        self.byte_ids = np.array([vocabulary.byte_ids.get(b, -1) for b in range(256)], np.int64)
        joined = np.zeros((256, 256), bool)
        for k, piece in enumerate(vocabulary.pieces.values()):
            at = 0
            for b in piece:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][b]
            ends[at] = k
            for a, b in zip(piece, piece[1:], strict=False):
                joined[a, b] = True
        n = len(children)
        self.goto = np.zeros((n, 256), np.int32)
        self.out, self.more = np.full(n, -1, np.int64), np.full(max(1, len(self.ids)), -1, np.int64)
        fail = [0] * n
        queue = deque()
        for b, c in children[0].items():
            self.goto[0, b] = c
            queue.append(c)
            self.out[c] = ends[c]
        while queue:
            s = queue.popleft()
            f = fail[s]
            self.goto[s] = self.goto[f]
            for b, c in children[s].items():
                fail[c] = int(self.goto[f, b])
                self.goto[s, b] = c
                if ends[c] >= 0:
                    self.out[c], self.more[ends[c]] = ends[c], self.out[fail[c]]
                else:
                    self.out[c] = self.out[fail[c]]
                queue.append(c)
        lead = (np.arange(256) & 0xC0) != 0x80
        #: Whether every segmentation cuts between two bytes: they touch in no piece, and the second begins a character.
        self.cut = ~joined & lead[None, :]
        self.lead = lead

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The start and end of each unit of a chunk, and the bounds of each text in them."""
        n = len(data)
        first = np.ones(n, bool)
        if n > 1:
            first[1:] = self.cut[data[:-1], data[1:]]
        first[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(first)
        return start, np.append(start[1:], n) if len(start) else start, np.searchsorted(start, offsets)

    def matches(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """For units from the longest to the shortest, each end of a match in turn: yields (step, units, places by match round).

        Each round is (indices of units, piece numbers or -1 for an unknown character, lengths); a unit's
        matches come longest first, an unknown character last, and only if it is no piece itself.
        """
        lengths = end - start
        n = len(start)
        state, char = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for t in range(int(lengths[0]) if n else 0):
            live = int(np.searchsorted(-lengths, -t, "left"))  # lengths > t
            at = start[:live] + t
            b = data[at]
            s = self.goto[state[:live], b]
            state[:live] = s
            head = self.lead[b]
            c = char[:live]
            c[head] = t
            whole = np.ones(live, bool)
            on = lengths[:live] > t + 1
            whole[on] = self.lead[data[at[on] + 1]]
            out = self.out[s]
            rounds, single = [], np.zeros(live, bool)
            idx = np.flatnonzero(out >= 0)
            p = out[idx]
            while len(idx):
                size = self.lengths[p]
                rounds.append((idx, p, size))
                single[idx] |= t + 1 - size == c[idx]
                p = self.more[p]
                on = p >= 0
                idx, p = idx[on], p[on]
            idx = np.flatnonzero(whole & ~single)
            if len(idx):
                rounds.append((idx, np.full(len(idx), -1), t + 1 - c[idx]))
            yield t, rounds

    def best(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best score of each unit and its number of pieces. Of equal scores the one whose last piece is longest holds, at every end; an unknown character is as many pieces as it has bytes."""
        order = np.argsort(start - end, kind="stable")
        start, end = start[order], end[order]
        base = np.concatenate([[0], np.cumsum(end - start + 1)])
        score, count = np.full(base[-1], -np.inf), np.zeros(base[-1], np.int64)
        score[base[:-1]] = 0
        for t, rounds in self.matches(data, start, end):
            for idx, p, size in rounds:
                to, came = base[idx] + t + 1, base[idx] + t + 1 - size
                unknown = p[0] < 0
                made = score[came] + (self.unknown if unknown else self.scores[p])
                better = made > score[to]
                to, came = to[better], came[better]
                score[to] = made[better]
                count[to] = count[came] + (size[better] if unknown else 1)
        last = base[1:] - 1
        out_score, out_count = np.empty(len(start)), np.empty(len(start), np.int64)
        out_score[order], out_count[order] = score[last], count[last]
        return out_score, out_count


_made: dict[str, Automaton] = cache()


def shared_automaton(spark, vocabulary: Vocabulary) -> str:
    """Makes the vocabulary's automaton, whose size is the vocabulary's, and puts it in the shared folder: its URI."""
    uri = shared_folder(spark, "automaton")
    machine = Automaton(vocabulary)
    write_file(f"{uri}/goto", np.ascontiguousarray(machine.goto).data)
    rest = dict(vars(machine), goto=machine.goto.shape)
    write_file(f"{uri}/rest", pickle.dumps(rest))
    return uri


def automaton(uri: str) -> Automaton:
    """The automaton at a URI, its table mapped into memory: all workers of a machine have one copy."""
    if uri not in _made:
        _made.clear()
        machine = Automaton.__new__(Automaton)
        vars(machine).update(pickle.loads(read_file(f"{uri}/rest")))
        machine.goto = map_file(f"{uri}/goto", np.dtype(np.int32)).reshape(machine.goto)
        _made[uri] = machine
    return _made[uri]


def marked(column, offset_text: str = " "):
    """Each text as the encoder sees it: the mark is a space, and one space goes before a text that isn't empty. Null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), MARK, " ")
    return pc.if_else(pc.equal(pc.binary_length(text), 0), "", pc.binary_join_element_wise(pa.scalar(offset_text, pa.large_string()), text, pa.scalar("", pa.large_string())))
