"""The order-dependent step of template mining: one shard's tree and clusters, fed line by line.

Small on purpose. Spark partitions, orders and hands over the lines (see :mod:`faultline.operators.templates`);
this module only answers "which cluster does this line join, and what does the template become".
"""

from __future__ import annotations

from array import array
from collections import Counter, OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np

WILD = 0  # code of a wildcard position
MAX_BAGS = 16384  # token sets kept of templates
FEW = 12  # clusters of a leaf that are all compared
MANY = 1024  # entries of lists from which they are counted by NumPy
NO_SIZE = 1 << 30  # size of a forgotten cluster's set, which no overlap reaches


@dataclass(frozen=True)
class MinerConfig:
    """``engine`` "length": shards are token counts. "jaccard": shards are first tokens, scores compare sets.

    ``max_clusters`` is the cap of the length engine, per shard: beyond it the cluster updated longest ago is forgotten.
    The set engine knows no cap but ``max_clusters_per_word``, a bound per first word, which is not a cap over all words.
    """

    sim_th: float = 0.8
    depth: int = 4
    max_children: int = 100
    max_clusters: int | None = 16384
    max_clusters_per_word: int | None = None
    parametrize_numeric: bool = True
    param: str = "<*>"
    engine: str = "length"

    def __post_init__(self) -> None:
        if self.depth < 3:
            raise ValueError("depth must be at least 3")

    @property
    def cap(self) -> int | None:
        """Most clusters of a shard."""
        return self.max_clusters if self.engine == "length" else self.max_clusters_per_word

    def path_tokens(self, tokens: list[str]) -> list[str]:
        """The tokens that route a line below its shard."""
        n = len(tokens)
        if self.engine == "jaccard":
            return tokens[1:1 + max(0, min(self.depth - 3, n - 2))]
        return tokens[:max(0, min(self.depth - 3, n - 1))]


class Codes(dict):
    """Token -> code of the tokens of templates. A literal wildcard in a line equals no template position, and neither
    does a token that no template has."""

    def __init__(self, param: str):
        super().__init__({param: -1})

    def __missing__(self, token: str) -> int:
        code = self[token] = len(self)
        return code

    def seen(self, tokens: list[str]) -> np.ndarray:
        """Codes to compare with; nothing is kept of other tokens."""
        return np.array([self.get(t, -2) for t in tokens], np.int32)


@dataclass
class Footprint:
    """What the lines since some state looked at and changed: leaves, children that were not there, children opened.

    A run from an old state is worth as much as one from the newest if nothing it looked at has been changed since, and if
    what limits growth (children of a node, clusters of the shard) was not near. A child never goes, so a step that finds one
    depends on nothing.
    """

    reads: set[str] = field(default_factory=set)
    writes: set[str] = field(default_factory=set)
    opened: dict[str, int] = field(default_factory=dict)  # children by node
    created: int = 0
    evicted: bool = False


def _leaf(path: tuple) -> str:
    return "L " + " ".join(path)


def _child(path: tuple, token: str) -> str:
    return "K " + " ".join((*path, token))


class Leaf:
    """Clusters of one leaf. Each has a place; places go up in insertion order, and that of a forgotten cluster stays empty
    until the leaf is packed. Templates of equal length are rows of one code matrix.

    ``lists`` names, for a token, the places whose template may hold it. Length engine: a key is a position and a code, and of
    the literals of a template only the rarest are listed, one more than may fail, so that a line similar enough meets one of
    them. Set engine: a key is a token, all are listed. Templates with a wildcard are also listed in ``blanks`` by length and
    token, as a line of that length is compared in their other positions only. Entries that have become untrue stay; scores are
    always taken anew. ``sized`` has the sizes of a template's token set, with and without a wildcard.
    """

    def __init__(self, width: int | None):
        self.ids: list[int | None] = []
        self.at: dict[int, int] = {}
        self.width = width
        self.codes = np.zeros((4, width), np.int32) if width is not None else None
        self.wild = np.zeros(4, np.int32)
        self.lists: dict = {}
        self.loose: list[int] = []  # set engine: templates without a literal
        self.blanks: dict[tuple[int, str], array] = {}
        self.blank_length: dict[int, int] = {}  # place -> length it is listed under in ``blanks``
        self.sized = np.full((4, 2), NO_SIZE, np.int32) if width is None else None

    def add(self, cid: int, codes: np.ndarray | None, wild: int) -> int:
        n = len(self.ids)
        if n == len(self.wild):
            self.wild = np.concatenate([self.wild, np.zeros(n, np.int32)])
            if self.codes is not None:
                self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
            else:
                self.sized = np.concatenate([self.sized, np.full((n, 2), NO_SIZE, np.int32)])
        self.wild[n] = wild
        if self.codes is not None:
            self.codes[n] = codes
        self.ids.append(cid)
        self.at[cid] = n
        return n

    def put(self, key, at: int) -> None:
        held = self.lists.get(key)
        if held is None:
            self.lists[key] = array("i", (at,)) if self.codes is None else [at]
        else:
            held.append(at)

    def put_blank(self, words: set[str], length: int, at: int) -> None:
        """Set engine: list a template with a wildcard by its length, once per length."""
        if self.blank_length.get(at) != length:
            self.blank_length[at] = length
            for t in words:
                held = self.blanks.get((length, t))
                if held is None:
                    self.blanks[length, t] = array("i", (at,))
                else:
                    held.append(at)

    def live(self) -> list[int]:
        """Clusters in insertion order."""
        return list(self.at)

    def drop(self, cid: int) -> None:
        at = self.at.pop(cid)
        self.ids[at] = None
        if self.codes is not None:
            self.codes[at] = WILD
        else:
            self.sized[at] = NO_SIZE
        if len(self.ids) > 64 and len(self.at) * 2 < len(self.ids):
            self._pack()

    def _pack(self) -> None:
        keep = list(self.at.values())
        moved = {old: new for new, old in enumerate(keep)}
        self.ids = [self.ids[i] for i in keep]
        self.wild = self.wild[keep]
        if self.codes is not None:
            self.codes = self.codes[keep]
        else:
            self.sized = self.sized[keep]
            self.blank_length = {moved[i]: n for i, n in self.blank_length.items() if i in moved}
            blanks = {k: array("i", [moved[i] for i in v if i in moved]) for k, v in self.blanks.items()}
            self.blanks = {k: v for k, v in blanks.items() if v}
        self.at = {cid: i for i, cid in enumerate(self.ids)}
        lists = {k: [moved[i] for i in v if i in moved] for k, v in self.lists.items()}
        if self.codes is None:
            lists = {k: array("i", v) for k, v in lists.items()}
        self.lists = {k: v for k, v in lists.items() if v}
        self.loose = [moved[i] for i in self.loose if i in moved]


class Shard:
    """Tree, clusters and recency of one shard."""

    def __init__(self, cfg: MinerConfig, rows: Iterable[dict] = ()):
        self.cfg = cfg
        self.kids: dict[tuple, dict] = {}
        self.leaves: dict[tuple, Leaf] = {}
        self.templates: dict[int, list[str]] = {}
        self.home: dict[int, tuple] = {}
        self.touched: OrderedDict[int, int] = OrderedDict()
        self.codebook = Codes(cfg.param)
        self.texts: dict[int, str] = {}
        self.bags: dict[int, tuple[set, set]] = {}
        self.often: Counter = Counter()  # tokens of templates, to tell rare ones
        self.needs: dict[int, int] = {}
        self.next_id = 0
        self.steps = Footprint()
        self.looked: set[tuple] = set()
        rows = sorted(rows, key=lambda r: r["tree_ord"])
        for r in rows if cfg.engine == "length" else ():
            self.often.update(self.codebook[t] for t in r["tokens"] or ())
        for r in rows:
            path = tuple(r["leaf_path"].split(" ")) if r["leaf_path"] else ()
            self._open(path)
            self.next_id = max(self.next_id, r["next_id"])
            if r["local_id"] is not None:
                self._place(path, r["local_id"], r["tokens"])
        for r in sorted((r for r in rows if r["local_id"] is not None), key=lambda r: r["touched"]):
            self.touched[r["local_id"]] = r["touched"]

    # -- tree ---------------------------------------------------------------------------------------------------

    def _open(self, path: tuple) -> None:
        for i in range(len(path)):
            self.kids.setdefault(path[:i], {}).setdefault(path[i])

    def route(self, tokens: list[str]) -> tuple | None:
        """Walk down: the token's own child first, else the wildcard child."""
        path: tuple = ()
        for t in self.cfg.path_tokens(tokens):
            kids = self.kids.get(path, {})
            if t in kids:
                path += (t,)
                continue
            self.steps.reads.add(_child(path, t))
            if self.cfg.param not in kids:
                self.steps.reads.add(_child(path, self.cfg.param))
                return None
            path += (self.cfg.param,)
        self.looked.add(path)
        return path

    def _grow(self, tokens: list[str]) -> tuple:
        """Path for a new cluster; opens children while there is room, else uses the wildcard child."""
        cfg, path = self.cfg, ()
        for t in cfg.path_tokens(tokens):
            kids = self.kids.setdefault(path, {})
            if t not in kids:
                numeric = cfg.parametrize_numeric and any(ch.isdigit() for ch in t)
                # the last free place is kept for the wildcard child
                room = len(kids) + (0 if cfg.param in kids else 1) < cfg.max_children
                if numeric or not room:
                    t = cfg.param
                if t not in kids:
                    kids[t] = None
                    self.steps.writes.add(_child(path, t))
                    node = " ".join(path)
                    self.steps.opened[node] = self.steps.opened.get(node, 0) + 1
            path += (t,)
        return path

    # -- clusters -----------------------------------------------------------------------------------------------

    def _encode(self, tokens: list[str]) -> np.ndarray | None:
        if self.cfg.engine != "length":
            return None
        book = self.codebook
        return np.array([book[t] for t in tokens], np.int32)

    def _seen(self, tokens: list[str]) -> np.ndarray | None:
        return self.codebook.seen(tokens) if self.cfg.engine == "length" else None

    def _place(self, path: tuple, cid: int, tokens: list[str], codes: np.ndarray | None = None) -> None:
        codes = self._encode(tokens) if codes is None else codes
        leaf = self.leaves.get(path)
        if leaf is None:
            leaf = self.leaves[path] = Leaf(None if codes is None else len(codes))
        at = leaf.add(cid, None if codes is None else np.where(codes < 0, WILD, codes), tokens.count(self.cfg.param))
        self.templates[cid] = list(tokens)
        self.home[cid] = path
        if codes is None:
            words = set(tokens) - {self.cfg.param}
            self._sized(leaf, at, cid, words)
            for t in words:
                leaf.put(t, at)
            if not words:
                leaf.loose.append(at)
            return
        literal = [(i, c) for i, c in enumerate(codes.tolist()) if c > 0]
        listed = len(literal) - self._need(len(tokens)) + 1
        if 0 < listed < len(literal):
            often = self.often
            literal = sorted(literal, key=lambda x: often[x[1]])[:listed]
        if listed > 0:
            width = leaf.width
            for i, c in literal:
                leaf.put(c * width + i, at)

    def _sized(self, leaf: Leaf, at: int, cid: int, words: set[str]) -> None:
        """Tokens of a template's set, with and without a wildcard."""
        template = self.templates[cid]
        blank = self.cfg.param in template
        leaf.sized[at] = (len(words) + blank, len(words))
        if blank:
            leaf.put_blank(words, len(template), at)

    def _need(self, n: int) -> int:
        """Fewest equal positions of ``n`` that reach the threshold."""
        need = self.needs.get(n)
        if need is None:
            need = 0
            while need <= n and n and need / n < self.cfg.sim_th:
                need += 1
            self.needs[n] = need
        return need

    def text(self, cid: int) -> str:
        """The template as text."""
        if cid not in self.texts:
            self.texts[cid] = " ".join(self.templates[cid])
        return self.texts[cid]

    def best(self, path: tuple | None, tokens: list[str], threshold: float, wild_counts: bool,
             codes: np.ndarray | None = None) -> int | None:
        """Best cluster of a leaf: similarity, then more wildcards, then the earliest."""
        leaf = self.leaves.get(path) if path is not None else None
        if leaf is None or not leaf.at:
            return None
        if not tokens:
            return next(iter(leaf.at))
        if self.cfg.engine == "length":
            codes = self._seen(tokens) if codes is None else codes
            at = self._similar(leaf, codes) if threshold == self.cfg.sim_th and not wild_counts else None
            if at is None:
                at = np.fromiter(leaf.at.values(), np.int64, len(leaf.at))
            if not len(at):
                return None
            same = (leaf.codes[at] == codes).sum(axis=1)
            score = (same + leaf.wild[at] if wild_counts else same) / len(tokens)
        else:
            at = self._overlapping(leaf, tokens, threshold, wild_counts)
            if not len(at):
                return None
            score = self._set_scores([leaf.ids[i] for i in at], tokens, wild_counts)
        top = score.max()
        if top < threshold:
            return None
        at = at[score == top]
        wild = leaf.wild[at]
        return leaf.ids[int(at[wild == wild.max()].min())]

    def _similar(self, leaf: Leaf, codes: np.ndarray) -> np.ndarray | None:
        """Places of all templates that may reach the threshold; None where looking at all is no more work."""
        if self._need(len(codes)) <= 0:
            return None
        found: list[int] = []
        lists, width = leaf.lists, leaf.width
        for i, c in enumerate(codes.tolist()):
            if c > 0:
                held = lists.get(c * width + i)
                if held is not None:
                    found += held
        if len(found) > 2 * len(leaf.at):
            return None
        return np.array(found, np.int64)  # places of forgotten clusters equal no line

    def _overlapping(self, leaf: Leaf, tokens: list[str], threshold: float, wild_counts: bool) -> np.ndarray:
        """Set engine: places of all templates that may reach the threshold. An overlap counts 1.3 times.

        Half of the tokens that have to be shared may be among the most frequent ones, so their long lists are not read: a
        template shares as many of the others as are then still lacking. Where a template's wildcards take positions of a line
        out of the comparison, the union is only known to be no smaller than the template's set; those are in ``blanks``.
        """
        if threshold <= 0 or len(leaf.at) <= FEW:
            return np.fromiter(leaf.at.values(), np.int64, len(leaf.at))
        words, param = set(tokens), self.cfg.param
        least = threshold / 1.3 - 1e-9
        more = int(not wild_counts and param in words)  # a literal wildcard overlaps that of a template
        lists = sorted(filter(None, map(leaf.lists.get, words)), key=len)
        lacking = least * len(words) - more
        skipped = min(len(lists), max(0, int(lacking) // 2))
        size = leaf.sized[:, int(wild_counts)]
        # both / (template + line - both) >= least
        share, extra = least / (1 + least), more + skipped
        at = _often(lists[:len(lists) - skipped], size, lambda n, s: (n + extra >= share * (s + len(words))) & (n + extra >= least * s))
        found = [at]
        if leaf.loose:
            found.append(np.array(leaf.loose, np.int64))
        if leaf.blanks:
            blanks = [held for t in words if (held := leaf.blanks.get((len(tokens), t))) is not None]
            if blanks:
                found.append(_often(blanks, size, lambda n, s: n + more >= least * s))
        if more:  # a literal wildcard overlaps templates that share nothing else
            every = np.fromiter(leaf.at.values(), np.int64, len(leaf.at))
            found.append(every[1 >= least * size[every]])
        if extra >= share * (1 + len(words)):  # the skipped lists alone may do for small templates
            every = np.fromiter(leaf.at.values(), np.int64, len(leaf.at))
            found.append(every[(extra >= share * (size[every] + len(words))) & (extra >= least * size[every])])
        if len(found) > 1:
            at = np.unique(np.concatenate(found))
        return at[size[at] < NO_SIZE]

    def _set_scores(self, ids: list[int], tokens: list[str], wild_counts: bool) -> np.ndarray:
        """:func:`set_score` of many clusters; the sets of a template are built once per change."""
        param, whole = self.cfg.param, set(tokens)
        out = np.empty(len(ids))
        for at, cid in enumerate(ids):
            template = self.templates[cid]
            bags = self.bags.get(cid)
            if bags is None:
                if len(self.bags) >= MAX_BAGS:
                    self.bags.clear()
                every = set(template)
                bags = self.bags[cid] = (every, every - {param})
            if len(template) == len(tokens) and param in bags[0]:
                out[at] = set_score(bags[wild_counts], {x for x, t in zip(tokens, template) if t != param})
            else:
                out[at] = set_score(bags[wild_counts], whole) if template else 1.0
        return out

    def best_anywhere(self, tokens: list[str], threshold: float) -> int | None:
        """Set engine: the best cluster of the whole shard, by the rules of :meth:`best`; the shard must not change."""
        if not hasattr(self, "_all"):
            self._all = [r["local_id"] for r in self.rows() if r["local_id"] is not None]
        if not self._all or not tokens:
            return self._all[0] if self._all else None
        score = self._set_scores(self._all, tokens, True)
        top = score.max()
        if top < threshold:
            return None
        wild = np.array([self.templates[c].count(self.cfg.param) for c in self._all])
        return self._all[int(np.where(score == top, wild, -1).argmax())]

    def add(self, tokens: list[str], pos: int) -> tuple[str, int]:
        """Feed one line; returns (change, cluster)."""
        codes = self._seen(tokens)
        cid = self.best(self.route(tokens), tokens, self.cfg.sim_th, False, codes)
        if cid is None:
            if self.cfg.cap is not None and len(self.templates) >= self.cfg.cap:
                self._evict()
            self.next_id += 1
            self.steps.created += 1
            cid = self.next_id
            if codes is not None:
                self.often.update(self.codebook[t] for t in tokens)
            self._place(self._grow(tokens), cid, tokens)
            change = "cluster_created"
        else:
            changed = self._merge_sets(cid, tokens) if codes is None else self._merge(cid, codes)
            change = "cluster_template_changed" if changed else "none"
        if change != "none":
            self.steps.writes.add(_leaf(self.home[cid]))
        self.touched[cid] = pos
        self.touched.move_to_end(cid)
        return change, cid

    def _merge(self, cid: int, codes: np.ndarray) -> bool:
        """Positions that differ become wildcards; tells whether there were any."""
        leaf = self.leaves[self.home[cid]]
        at = leaf.at[cid]
        apart = np.flatnonzero((leaf.codes[at] != codes) & (leaf.codes[at] != WILD))
        if not len(apart):
            return False
        leaf.codes[at, apart] = WILD
        leaf.wild[at] += len(apart)
        for i in apart:
            self.templates[cid][i] = self.cfg.param
        self.texts.pop(cid, None)
        return True

    def _merge_sets(self, cid: int, line: list[str]) -> bool:
        """Set engine: by position for equal lengths, else the longer one keeps the tokens both have."""
        param, template = self.cfg.param, self.templates[cid]
        if len(line) == len(template):
            merged = [b if a == b else param for a, b in zip(line, template)]
        else:
            shared = set(line) & set(template)
            merged = [t if t in shared else param for t in (line if len(line) > len(template) else template)]
        if merged == template:
            return False
        leaf = self.leaves[self.home[cid]]
        at = leaf.at[cid]
        leaf.wild[at] = merged.count(param)
        self.templates[cid] = merged
        words = set(merged) - {param}
        self._sized(leaf, at, cid, words)
        if not words:
            leaf.loose.append(at)
        self.texts.pop(cid, None)
        self.bags.pop(cid, None)
        return True

    def _evict(self) -> None:
        """Forget the cluster that was updated longest ago; its leaf stays open."""
        cid, _ = self.touched.popitem(last=False)
        self.steps.writes.add(_leaf(self.home[cid]))
        self.steps.evicted = True
        self._forget(cid)

    def _forget(self, cid: int) -> None:
        self.leaves[self.home.pop(cid)].drop(cid)
        del self.templates[cid]
        self.texts.pop(cid, None)
        self.bags.pop(cid, None)

    # -- runs from an older state ---------------------------------------------------------------------------------

    @property
    def evicted(self) -> bool:
        """Has a cluster been forgotten?"""
        return self.steps.evicted

    def footprint(self) -> Footprint:
        """What all lines fed so far looked at and changed."""
        self.steps.reads.update(map(_leaf, self.looked))
        return self.steps

    def allows(self, run: Footprint, changed: set[str], opened: dict[str, int]) -> bool:
        """Would ``run``, made before the ``changed`` and ``opened`` things were, come out the same from here?"""
        if run.evicted or self.cfg.cap is not None and run.created and len(self.templates) + run.created > self.cfg.cap:
            return False
        if not changed.isdisjoint(run.reads):
            return False
        nodes = ((tuple(node.split(" ")) if node else (), n) for node, n in run.opened.items() if node in opened)
        return all(len(self.kids.get(path, {})) + n + 1 <= self.cfg.max_children for path, n in nodes)

    def take_over(self, rows: Iterable[dict], base: int, shift: int, created: int) -> None:
        """Leaves as a run left them, in the run's order; ids that it made beyond ``base`` move up by ``shift``."""
        rows = list(rows)
        for path in dict.fromkeys(r["leaf_path"] for r in rows):
            leaf = self.leaves.get(tuple(path.split(" ")) if path else ())
            for cid in leaf.live() if leaf else ():
                self._forget(cid)
                self.touched.pop(cid, None)
        for r in rows:
            path = tuple(r["leaf_path"].split(" ")) if r["leaf_path"] else ()
            self._open(path)
            if r["local_id"] is not None:
                cid = r["local_id"] + (shift if r["local_id"] > base else 0)
                self._place(path, cid, r["tokens"])
                self.touched[cid] = r["touched"]
        self.next_id += created

    def rows(self) -> Iterator[dict]:
        """Catalogue rows in tree order; a leaf without clusters keeps one row so that routing survives a reload."""
        order = 0
        stack: list[tuple] = [()]
        while stack:
            path = stack.pop()
            kids = self.kids.get(path, {})
            leaf = self.leaves.get(path)
            ids = leaf.live() if leaf else []
            for cid in ids or ([None] if not kids else []):
                yield {"local_id": cid, "tokens": self.templates.get(cid), "leaf_path": " ".join(path),
                       "tree_ord": order, "touched": self.touched.get(cid, -1), "next_id": self.next_id}
                order += 1
            stack.extend(path + (k,) for k in reversed(kids))


def _often(lists: list[array], size: np.ndarray, enough) -> np.ndarray:
    """Places of the lists for which ``enough(times listed, size)`` holds."""
    if sum(map(len, lists)) < MANY:
        hits = Counter(chain.from_iterable(lists))
        at, n = np.fromiter(hits, np.int64, len(hits)), np.fromiter(hits.values(), np.int64, len(hits))
    else:
        times = np.bincount(np.concatenate([np.frombuffer(held, np.int32) for held in lists]))
        at = np.flatnonzero(times)
        n = times[at]
    return at[enough(n, size[at])]


def set_score(template: set[str], line: set[str]) -> float:
    """Overlap of two token sets, times 1.3, at most 1. Two empty sets (wildcards alone) fit."""
    both = len(template & line)
    union = len(template) + len(line) - both
    return min(1.0, 1.3 * both / union) if union else 1.0
