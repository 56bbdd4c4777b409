"""A skip-chain conditional random field over the tokens of texts, in blocks of texts.

Every line of a text is a chain of tokens. A token's own potential is a sum of
weights of features of the token and its neighbours (word, endings, shape), of the
shapes around it, of number and address formats it stands in together with the words
before them, of quotation marks and of repeats in the text. Neighbours share a
transition potential. Capitalised tokens of one text with the same or a similar word
share a skip potential over "is it part of a name". Chain weights are fitted by
maximum likelihood, the skip potential by the counts of equal and unequal answers in
the fitted texts. Messages go along the chains by forward and backward passes and
over the skip edges until they settle; labels are the best paths given the messages.

All passes run over whole blocks with numpy: step t handles the t-th token of every
chain that is that long.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import count
from operator import itemgetter

import numpy as np

from vellum.llm.pii_cues import QUOTED, THEATRE, TOKEN, formats, reformed, shape

KINDS = ["email", "phone", "id_number", "address", "name"]
LABELS = ["O"] + [f"{side}-{kind}" for kind in KINDS for side in "BI"]
AT = {label: i for i, label in enumerate(LABELS)}
L = len(LABELS)
NAMES = [AT["B-name"], AT["I-name"]]
OFFSETS = (-2, -1, 0, 1, 2)
#: A feature must come up this often in the fitted texts to have a weight.
LEAST_SEEN = 3
#: Shortest word that skip edges link.
LINKED = 4
#: Messages are settled when none changes by more than this; share of the old message kept.
SETTLED, KEPT = 0.01, 0.5
#: Rounds after which a text keeps the last, damped messages. Texts settle in far fewer.
ROUNDS = 100
#: Log odds beyond which an answer is as good as certain; half of it bounds the sum of the
#: messages a token hears. A token less likely than CERTAIN to be in anything cuts its line.
MOST, CERTAIN = 24.0, 1e-6
#: The patterns pass over bare repeats of a name, so that the fitted texts say too surely
#: that a lone capitalised word is none: the most that a linked token may deny by itself.
DOUBT = 4.0
#: Counts put before those of the fitted texts: equal answers of linked words are usual.
PRIOR_SAME, PRIOR_OTHER = 20.0, 1.0
#: Tokens of a block.
BLOCK = 150_000
#: Shapes told apart, and templates of shapes around a token.
SHAPES, TEMPLATES = 64, 6


def allowed() -> np.ndarray:
    """True where a label may follow another; a later token only after its own kind."""
    ok = np.ones((L, L), dtype=bool)
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            for i, before in enumerate(LABELS):
                ok[i, j] = before[1:] == label[1:] and i > 0
    return ok


_OK = allowed()
_FIRST = np.array([label[0] != "I" for label in LABELS])


def word_features(word: str) -> list[str]:
    low = reformed(word)
    kind = shape(word)
    return [f"w={low}", f"a={low[-2:]}|{kind}", f"b={low[-3:]}", f"c={low[-4:]}", f"p={low[:3]}", f"s={kind}", f"l={min(len(low), 12)}|{kind}"]


def stem(word: str) -> str:
    """A word without case endings and letter case."""
    low = reformed(word)
    for end in ("ымъ", "ого", "ому", "аго", "ым", "им", "ом", "ем", "ой", "ою", "ая", "ую", "ый", "ій", "ий", "а", "у", "ы", "е"):
        if low.endswith(end) and len(low) - len(end) >= LINKED:
            return low[: -len(end)]
    return low.removesuffix("'s").removesuffix("’s")


@dataclass
class Block:
    """Tokens of several texts."""

    n_texts: int
    words: list[str] = field(default_factory=list)  # distinct
    ids: np.ndarray | None = None  # word of each token
    start: np.ndarray | None = None
    end: np.ndarray | None = None
    text: np.ndarray | None = None  # text of each token
    quoted: np.ndarray | None = None
    repeat: np.ndarray | None = None
    chains: tuple[np.ndarray, np.ndarray] | None = None  # first tokens and lengths, longest first
    formed: list[tuple[int, list[str]]] = field(default_factory=list)  # token, features of its format
    groups: list[np.ndarray] = field(default_factory=list)  # tokens of one word in one text


def _inside(spans: list[tuple[int, int]], at: np.ndarray) -> np.ndarray:
    """Whether a position lies in one of the spans."""
    if not spans:
        return np.zeros(len(at), dtype=bool)
    both = np.array(sorted(spans))
    k = np.searchsorted(both[:, 0], at, side="right") - 1
    return (k >= 0) & (at < np.maximum.accumulate(both[:, 1])[np.maximum(k, 0)])


def read_block(texts: list[str]) -> Block:
    """Tokens, lines, formats, quotation marks and repeats of the texts."""
    block = Block(len(texts))
    known: dict[str, int] = defaultdict(count().__next__)
    ids: list[int] = []
    spans: list[tuple[int, int]] = []
    sizes, bases = [], []
    lines: list[int] = []
    quoted: list[tuple[int, int]] = []
    bound: list[tuple[int, int]] = []
    base = 0  # places of all texts set one behind the other
    for text in texts:
        own = [m.span() for m in TOKEN.finditer(text)]
        first_token = len(spans)
        spans += own
        ids.extend(map(known.__getitem__, [text[a:b] for a, b in own]))
        sizes.append(len(own))
        bases.append(base)
        at = text.find("\n")
        while at >= 0:
            lines.append(base + at)
            at = text.find("\n", at + 1)
        for mark in (QUOTED, THEATRE):
            quoted += [(base + m.start(), base + m.end()) for m in mark.finditer(text)]
        for kind, a, b in formats(text):
            first, last = bisect_right(own, a, key=itemgetter(1)), bisect_left(own, b, key=itemgetter(0))
            if kind in ("email", "address"):
                bound.append((base + a, base + b))
            before = [text[x:y].lower() for x, y in own[max(0, first - 7) : first] if text[x:y].isalpha()]
            after = text[slice(*own[last])].lower() if last < len(own) else "$"
            for j in range(first, last):
                side = "B" if j == first else "E" if j == last - 1 else "I"
                seen = [f"f={kind}|{side}", f"f={kind}|{side}|{before[-1] if before else '^'}", f"f={kind}|{side}|>{after}"]
                seen += [f"f={kind}|{'B' if j == first else 'I'}|*{word}" for word in before]
                block.formed.append((first_token + j, seen))
        base += len(text) + 1
    n = len(spans)
    block.words = list(known)
    block.ids = np.array(ids, dtype=np.int64)
    both = np.array(spans, dtype=np.int64).reshape(-1, 2)
    block.start, block.end = both[:, 0], both[:, 1]
    block.text = np.repeat(np.arange(len(texts)), sizes)
    place = block.start + np.array(bases, dtype=np.int64)[block.text] if n else block.start
    block.quoted = _inside(quoted, place)
    line = np.searchsorted(np.array(lines, dtype=np.int64), place)
    new = np.ones(n, dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (block.text[1:] != block.text[:-1])
    firsts = np.flatnonzero(new)
    lengths = np.diff(np.append(firsts, n))
    order = np.argsort(-lengths, kind="stable")
    block.chains = (firsts[order], lengths[order])
    numbers: dict[str, int] = defaultdict(count().__next__)
    stems = np.array([numbers[stem(w)] if len(w) >= LINKED and w[0].isupper() else -1 for w in block.words], dtype=np.int64)
    linked = np.flatnonzero((stems[block.ids] >= 0) & ~_inside(bound, place)) if n else np.empty(0, dtype=np.int64)
    key = block.text[linked] * (len(numbers) + 1) + stems[block.ids[linked]]
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    block.groups = [g for g in np.split(linked[order], cuts) if len(g) > 1]
    block.repeat = np.zeros(n, dtype=np.int64)
    if block.groups:
        block.repeat[np.concatenate(block.groups)] = 1
    return block


def steps(chains: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """For each step the tokens it handles, longest chains first."""
    firsts, lengths = chains
    if not len(firsts):
        return []
    longest = int(lengths[0])
    live = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains longer than t
    return [firsts[: live[t]] + t for t in range(longest)]


def shifted(values: np.ndarray, block: Block, offset: int, edge: int) -> np.ndarray:
    """The values of the tokens ``offset`` further in the same line, else ``edge``."""
    out = np.full(len(values), edge, dtype=np.int64)
    line = np.zeros(len(values), dtype=np.int64)
    line[np.sort(block.chains[0])] = 1
    line = np.cumsum(line)
    n = len(values)
    if abs(offset) >= n and offset:
        return out
    if offset == 0:
        return values.copy()
    a, b = (slice(0, n - offset), slice(offset, n)) if offset > 0 else (slice(-offset, n), slice(0, n + offset))
    same = line[a] == line[b]
    out[a] = np.where(same, values[b], edge)
    return out


def _around(block: Block, kind: np.ndarray, initial: int, point: int) -> list[np.ndarray]:
    """Codes of a token's shape with the next and the last word beyond initials and
    points, and how many initials stand between."""
    n = len(kind)
    if not n:
        return [np.zeros(0, dtype=np.int64)] * 3
    line = np.zeros(n, dtype=np.int64)
    line[block.chains[0]] = 1
    line = np.cumsum(line)
    index = np.arange(n)
    one = kind == initial
    passed = np.concatenate([[0], np.cumsum(one)])
    plain = ~one & (kind != point)
    before = np.maximum.accumulate(np.where(plain, index, -1))
    behind = np.minimum.accumulate(np.where(plain, index, n)[::-1])[::-1]
    last = np.concatenate([[-1], before[:-1]])
    next_ = np.concatenate([behind[1:], [n]])
    in_line = lambda at: (at >= 0) & (at < n) & (line[at.clip(0, n - 1)] == line)
    has_last, has_next = in_line(last), in_line(next_)
    k_last = np.where(has_last, kind[last.clip(0)], 0)
    k_next = np.where(has_next, kind[next_.clip(0, n - 1)], 0)
    n_last = np.where(has_last, passed[index] - passed[last.clip(0) + 1], 0).clip(0, 3)
    n_next = np.where(has_next, passed[next_.clip(0, n - 1)] - passed[index + 1], 0).clip(0, 3)
    left, right = n_last * SHAPES + k_last, n_next * SHAPES + k_next
    wide = 4 * SHAPES
    return [left * SHAPES + kind, right * SHAPES + kind, (left * wide + right) * SHAPES + kind]


class Field:
    """Weights of the random field."""

    def __init__(self) -> None:
        self.features: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.w: dict[str, np.ndarray] = {}
        self.skip = np.zeros((2, 2))  # log potential of (in a name?, in a name?)
        self._seen: dict[str, tuple[list[int], int]] = {}

    def __getstate__(self):
        return {**self.__dict__, "_seen": {}}

    # features

    def _word(self, word: str) -> tuple[list[int], int]:
        got = self._seen.get(word)
        if got is None:
            if len(self._seen) > 300_000:
                self._seen.clear()
            got = ([self.features.get(f, 0) for f in word_features(word)], self.shapes.get(shape(word), 1))
            self._seen[word] = got
        return got

    def design(self, block: Block) -> dict[str, np.ndarray]:
        """Indices of all weights a token's potential is the sum of."""
        told = [self._word(w) for w in block.words]
        rows = np.array([t[0] for t in told] + [[0] * 7], dtype=np.int64).reshape(-1, 7)
        kinds = np.array([t[1] for t in told] + [0], dtype=np.int64)
        edge = len(block.words)
        at = {o: shifted(block.ids, block, o, edge) for o in OFFSETS}
        k = {o: kinds[at[o]] for o in OFFSETS}
        around = _around(block, kinds[at[0]], self.shapes.get("I", -1), self.shapes.get(".", -1))
        code = [(k[a] * SHAPES + k[b]) * SHAPES + k[c] for a, b, c in ((-1, 0, 1), (-2, -1, 0), (0, 1, 2))]
        code += around
        ready = {"rows": rows, "at": at, "codes": code, "flags": (block.quoted * 2 + block.repeat) * SHAPES + k[0], "form": self.formed(block)}
        if self.codes:
            ready["found"] = [self._found(slot, code[slot]) for slot in range(TEMPLATES)]
        return ready

    def _found(self, slot: int, code: np.ndarray) -> np.ndarray:
        """Rows of the shape codes, 0 for codes without a weight."""
        known = self.codes[slot]
        k = np.minimum(np.searchsorted(known, code), len(known) - 1)
        return np.where(known[k] == code, k + 1, 0)

    def formed(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(t, self.features.get(f, 0)) for t, fs in block.formed for f in fs]
        pairs = [p for p in pairs if p[1]]
        both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def potentials(self, block: Block, d: dict | None = None) -> np.ndarray:
        """A token's own potentials, one column a label."""
        d = d or self.design(block)
        own = np.zeros((len(block.ids), L), dtype=np.float32)
        for i, o in enumerate(OFFSETS):
            own += self.w["word"][i][d["rows"]].sum(axis=1, dtype=np.float32)[d["at"][o]]
        for slot in range(TEMPLATES):
            own += self.w["code"][slot][d["found"][slot]]
        own += self.w["flag"][d["flags"]]
        tokens, feats = d["form"]
        for label in range(L):
            own[:, label] += np.bincount(tokens, self.w["form"][feats, label], minlength=len(own)).astype(np.float32)
        return own + self.w["bias"]

    # passes

    def marginals(self, own: np.ndarray, chains, counts: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of each token's labels along the chains; adds the expected
        transitions to ``counts`` if given."""
        go = np.where(_OK, np.exp(self.w["step"]), 0.0).astype(own.dtype)
        p = np.exp(np.maximum(own - own.max(axis=1, keepdims=True), -40.0))
        path = steps(chains)
        ahead = np.empty_like(p)
        behind = np.ones_like(p)
        for t, tokens in enumerate(path):
            a = p[tokens] * (_FIRST if t == 0 else ahead[path[t - 1][: len(tokens)]] @ go)
            ahead[tokens] = a / a.sum(axis=1, keepdims=True)
        for t in range(len(path) - 1, 0, -1):
            tokens = path[t]
            before = path[t - 1][: len(tokens)]
            right = p[tokens] * behind[tokens]
            b = right @ go.T
            if counts is not None:
                left = ahead[before]
                z = (left * b).sum(axis=1, keepdims=True)
                counts += ((left / z).T @ right) * go
            behind[before] = b / b.sum(axis=1, keepdims=True)
        both = ahead * behind
        return both / both.sum(axis=1, keepdims=True)

    def best(self, own: np.ndarray, chains) -> np.ndarray:
        """Labels of the best path of every chain."""
        go = np.where(_OK, self.w["step"], -1e9).astype(np.float32)
        path = steps(chains)
        back = np.zeros(own.shape, dtype=np.int8)
        score = np.empty_like(own)
        for t, tokens in enumerate(path):
            if t == 0:
                score[tokens] = own[tokens] + np.where(_FIRST, 0.0, -1e9)
                continue
            options = score[path[t - 1][: len(tokens)]][:, :, None] + go
            back[tokens] = options.argmax(axis=1)
            score[tokens] = options.max(axis=1) + own[tokens]
        labels = np.zeros(len(own), dtype=np.int64)
        firsts, lengths = chains
        live = 0
        for t in range(len(path) - 1, -1, -1):
            tokens = path[t]
            ending = tokens[live:]  # chains whose last token this is
            if live:
                going = path[t + 1]
                labels[tokens[:live]] = back[going, labels[going]]
            labels[ending] = score[ending].argmax(axis=1)
            live = len(tokens)
        return labels

    def decode(self, block: Block) -> np.ndarray:
        """Labels of all tokens, with the messages of the skip edges."""
        if not len(block.ids):
            return np.zeros(0, dtype=np.int64)
        own = self.potentials(block)
        near = self.marginals(own, block.chains)
        own = self.doubted(block, own, near)
        told = self._messages(block, own, near)
        own[:, NAMES] += told[:, None].astype(np.float32)
        return self.best(own, block.chains)

    def doubted(self, block: Block, own: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Own potentials in which a linked token beside no name denies being one by no
        more than DOUBT."""
        if block.groups:
            linked = np.concatenate(block.groups)
            named = np.zeros(len(own) + 2)
            named[1:-1] = near[:, NAMES].sum(axis=1)
            lone = linked[(named[linked] < 0.5) & (named[linked + 2] < 0.5)]
            own[lone, NAMES[0]] = np.maximum(own[lone, NAMES[0]], own[lone].max(axis=1) - DOUBT)
        return own

    def _pass_on(self, odds: np.ndarray) -> np.ndarray:
        """What a skip edge tells of a token whose log odds of being in a name,
        without what the edges told it, are ``odds``."""
        s = self.skip
        return np.logaddexp(odds + s[1, 1], s[0, 1]) - np.logaddexp(odds + s[1, 0], s[0, 0])

    def _messages(self, block: Block, own: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Sum of the skip messages of every token, settled text by text."""
        told = np.zeros(len(own))
        part = near[:, NAMES].sum(axis=1)
        # where all answers are sure and equal the messages can only confirm them
        open_ = [g for g in block.groups if part[g].max() > 0.01 and part[g].min() < 0.99]
        if not open_:
            return told
        texts = np.unique(np.concatenate([block.text[g] for g in open_]))
        mixed = np.isin(block.text[np.array([g[0] for g in block.groups])], texts)
        groups = [g for g, m in zip(block.groups, mixed) if m]
        members = np.concatenate(groups)
        owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        # tokens that are certainly outside cut a line into independent pieces
        live = near[:, 0] < 1 - CERTAIN
        live[members] = True
        new_line = np.zeros(len(own) + 1, dtype=bool)
        new_line[block.chains[0]] = True
        new_line[-1] = True
        wide = live.copy()
        wide[1:] |= live[:-1] & ~new_line[1:-1]
        wide[:-1] |= live[1:] & ~new_line[1:-1]
        tokens = np.flatnonzero(wide & np.isin(block.text, texts))
        place = np.full(len(own), -1)
        place[tokens] = np.arange(len(tokens))
        begins = np.ones(len(tokens), dtype=bool)
        begins[1:] = (np.diff(tokens) > 1) | new_line[tokens[1:]]
        firsts = np.flatnonzero(begins)
        lengths = np.diff(np.append(firsts, len(tokens)))
        holds = np.zeros(len(firsts), dtype=bool)
        piece = np.cumsum(begins) - 1
        holds[piece[place[members]]] = True
        order = np.argsort(-lengths, kind="stable")
        order = order[holds[order]]
        chains = (firsts[order], lengths[order])
        sub, at = own[tokens].astype(np.float64), place[members]
        text_of = block.text[tokens]
        heard = np.zeros(len(members))
        for _ in range(ROUNDS):
            lifted = sub.copy()
            lifted[at[:, None], NAMES] += heard[:, None]
            p = self.marginals(lifted, chains)[at]
            odds = np.log(p[:, NAMES].sum(axis=1) + 1e-300) - np.log(p.sum(axis=1) - p[:, NAMES].sum(axis=1) + 1e-300)
            said = self._pass_on(odds.clip(-MOST, MOST) - heard)
            new = np.bincount(owner, said)[owner] - said
            new = KEPT * heard + (1 - KEPT) * new.clip(-MOST / 2, MOST / 2)
            change = np.abs(new - heard)
            heard = new
            told[members] = heard
            moving = np.unique(text_of[at[change > SETTLED]])
            if not len(moving):
                break
            rows = np.isin(text_of[chains[0]], moving)
            chains = (chains[0][rows], chains[1][rows])
            stay = np.isin(text_of[at], moving)
            members, at, heard, owner = members[stay], at[stay], heard[stay], np.unique(owner[stay], return_inverse=True)[1]
        return told

    # fitting

    def fit(self, blocks: list[Block], labels: list[np.ndarray], rounds: int = 8, rate: float = 0.3, shrink: float = 2e-6) -> Field:
        """Weights of the given labels by maximum likelihood (adaptive steps over the
        blocks); features come from the blocks. The same input gives the same weights."""
        seen: Counter = Counter()
        kinds: Counter = Counter()
        for b in blocks:
            told = np.bincount(b.ids, minlength=len(b.words))
            for word, n in zip(b.words, told.tolist()):
                kinds[shape(word)] += n
                for f in word_features(word):
                    seen[f] += n
            for _, fs in b.formed:
                seen.update(fs)
        self.features = {f: i + 1 for i, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST_SEEN))}
        self.shapes = {s: i + 2 for i, (s, _) in enumerate(sorted(kinds.items(), key=lambda x: (-x[1], x[0]))[: SHAPES - 2])}
        self._seen, self.codes = {}, []
        designs = [self.design(b) for b in blocks]
        for slot in range(TEMPLATES):
            code, n = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *(d["codes"][slot] for d in designs)]), return_counts=True)
            kept = code[n >= LEAST_SEEN]
            self.codes.append(kept if len(kept) else np.array([-1]))
        size = len(self.features) + 1
        zeros = lambda *shape: np.zeros((*shape, L), dtype=np.float32)
        self.w = {
            "word": [zeros(size) for _ in OFFSETS], "code": [zeros(len(c) + 1) for c in self.codes], "flag": zeros(4 * SHAPES), "form": zeros(size),
            "bias": np.zeros(L, dtype=np.float32), "step": np.zeros((L, L), dtype=np.float32),
        }
        past = {k: [np.full_like(x, 1e-2) for x in v] if isinstance(v, list) else np.full_like(v, 1e-2) for k, v in self.w.items()}

        def move(weights: np.ndarray, old: np.ndarray, grad: np.ndarray) -> None:
            grad = grad - shrink * weights
            old += grad * grad
            weights += rate * grad / np.sqrt(old)

        def gather(index: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
            return np.stack([np.bincount(index, g[:, label], minlength=size) for label in range(L)], axis=1).astype(np.float32)

        for d in designs:
            d["found"] = [self._found(slot, d["codes"][slot]) for slot in range(TEMPLATES)]
        for _ in range(rounds):
            for b, d, y in zip(blocks, designs, labels):
                form, found = d["form"], d["found"]
                n = len(b.ids)
                if not n:
                    continue
                own = self.potentials(b, d)
                counts = np.zeros((L, L), dtype=np.float32)
                g = -self.marginals(own, b.chains, counts)
                g[np.arange(n), y] += 1.0
                g /= n / 100.0
                firsts, _ = b.chains
                first = np.zeros(n, dtype=bool)
                first[firsts] = True
                later = np.flatnonzero(~first)
                true = np.zeros((L, L), dtype=np.float32)
                np.add.at(true, (y[later - 1], y[later]), 1.0)
                move(self.w["step"], past["step"], np.where(_OK, (true - counts) / (n / 100.0), 0.0).astype(np.float32))
                move(self.w["bias"], past["bias"], g.sum(axis=0))
                move(self.w["flag"], past["flag"], gather(d["flags"], g, 4 * SHAPES))
                move(self.w["form"], past["form"], gather(form[1], g[form[0]], size))
                for s in range(TEMPLATES):
                    grad = gather(found[s], g, len(self.codes[s]) + 1)
                    grad[0] = 0.0
                    move(self.w["code"][s], past["code"][s], grad)
                for i, o in enumerate(OFFSETS):
                    by_word = gather(d["at"][o], g, len(d["rows"]))
                    grad = np.zeros_like(self.w["word"][i])
                    for col in range(d["rows"].shape[1]):
                        grad += gather(d["rows"][:, col], by_word, size)
                    grad[0] = 0.0
                    move(self.w["word"][i], past["word"][i], grad)
        self._fit_skip(blocks, labels)
        return self

    def _fit_skip(self, blocks: list[Block], labels: list[np.ndarray]) -> None:
        """Lift of each pair of answers of linked tokens over chance."""
        pairs = np.array([[PRIOR_SAME, PRIOR_OTHER], [PRIOR_OTHER, PRIOR_SAME]])
        for b, y in zip(blocks, labels):
            named = np.isin(y, NAMES)
            for g in b.groups:
                yes = float(named[g].sum())
                no = len(g) - yes
                weight = 1.0 / (len(g) - 1)  # a group counts by its tokens
                pairs[1, 1] += yes * (yes - 1) * weight / 2
                pairs[0, 0] += no * (no - 1) * weight / 2
                pairs[0, 1] += yes * no * weight / 2
                pairs[1, 0] += yes * no * weight / 2
        total, side = pairs.sum(), pairs.sum(axis=0)
        self.skip = np.log(pairs * total / np.outer(side, side))


def blocks_of(texts: list[str]) -> list[tuple[list[int], Block]]:
    """The texts in blocks of about BLOCK tokens, with their places."""
    out, places, size = [], [], 0
    for i, t in enumerate(texts):
        places.append(i)
        size += len(t) // 5 + 1
        if size >= BLOCK:
            out.append((places, read_block([texts[j] for j in places])))
            places, size = [], 0
    if places:
        out.append((places, read_block([texts[j] for j in places])))
    return out


def weak_labels(block: Block, spans: list[list[tuple[str, int, int]]]) -> np.ndarray:
    """Labels of the tokens from spans of each text."""
    y = np.zeros(len(block.ids), dtype=np.int64)
    begin = np.searchsorted(block.text, np.arange(block.n_texts + 1))
    for t, cues in enumerate(spans):
        lo, hi = begin[t], begin[t + 1]
        for kind, a, b in cues:
            i, j = lo + np.searchsorted(block.end[lo:hi], a, side="right"), lo + np.searchsorted(block.start[lo:hi], b)
            if j > i:
                y[i] = AT[f"B-{kind}"]
                y[i + 1 : j] = AT[f"I-{kind}"]
    return y


def spans_of(block: Block, labels: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """Spans of every text: (kind, start, end)."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(block.n_texts)]
    for i in np.flatnonzero(labels):
        label, text = LABELS[labels[i]], block.text[i]
        if label[0] == "I" and out[text]:
            kind, a, _ = out[text][-1]
            out[text][-1] = (kind, a, int(block.end[i]))
        else:
            out[text].append((label[2:], int(block.start[i]), int(block.end[i])))
    return out
