"""A document's blocks, runs and segments, and the document rebuilt from translated segments; used inside workers.

A block is what stands between block elements' borders, its inline tags being placeholders. A run is a stretch
of text of one fate: translated (``chinese``), or held back under a placeholder (``tag``, ``entity_protected``,
``model_number_protected``, ``identifier_protected``, ``english_protected``). A segment is as many runs of a
block, in order, as fit the model's room; between two translated runs of a segment there is always a
placeholder, so the model's output splits at its placeholders into one piece a run.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain, groupby

from ..functions import patterns as P
from .html_tree import Node, Tree, end_tag, start_tag

# Elements that border blocks.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th caption blockquote div section article figure figcaption dt dd ul ol table tr tbody thead tfoot header footer main aside nav form".split())

HAN = re.compile("[一-鿿]")
MARKER = re.compile("\x02ITENT[0-9a-f]{8}\\d{4,}\x03")
TOKEN = re.compile(P.PLACEHOLDER)
ANY_TOKEN = re.compile(P.ANY_PLACEHOLDER)
#: What is held back in a text: other characters than CJK, without the white space at their ends.
HELD = re.compile(f"[^{P.CJK_PY}\\s](?:[^{P.CJK_PY}]*[^{P.CJK_PY}\\s])?")
IDENTIFIERS = [re.compile(p) for p in P.IDENTIFIERS.values()]
HINT = re.compile(P.HINT.replace("(?iU)", "(?i)"))


def measure(text: str) -> int:
    return max(1, (len(text) + 1) // 2)


def spaced(text: str) -> str:
    return TOKEN.sub(lambda m: f" {m[0]} ", text)


def free(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without overlap: the earliest first, of those the longest."""
    kept: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b))
    return kept


def identifiers(text: str) -> list[tuple[int, int]]:
    return free([m.span() for p in IDENTIFIERS for m in p.finditer(text)]) if HINT.search(text) else []


class Tokens:
    """Placeholders of a block and what they stand for."""

    def __init__(self) -> None:
        self.of: dict[str, str] = {}

    def new(self, content: str, letter: str) -> str:
        token = f"{P.PREFIX}{letter}{len(self.of) + 1:04d}_"
        self.of[token] = content
        return token


@dataclass(slots=True)
class Run:
    node_id: str
    kind: str
    raw: str
    placeholder: str | None = None
    offset_start: int = 0
    offset_end: int = 0
    sequence_index: int = 0
    slot_index: int | None = None

    @property
    def translate(self) -> bool:
        return self.placeholder is None

    @property
    def shown(self) -> str:
        return self.raw if self.placeholder is None else self.placeholder


@dataclass
class Segment:
    segment_id: str
    sequence_index: int
    block_key: str
    block_text: str
    source_text: str
    token_count: int
    runs: list[Run] = field(default_factory=list)
    tokens: dict[str, str] = field(default_factory=dict)

    @property
    def order(self) -> list[str]:
        return [r.placeholder for r in self.runs if r.placeholder]

    def row(self) -> dict:
        return {"segment_id": self.segment_id, "sequence_index": self.sequence_index, "block_key": self.block_key, "block_text": self.block_text, "source_text": self.source_text, "token_count": self.token_count,
                "placeholder_order": self.order, "contents": [r.raw for r in self.runs if r.placeholder], "runs": self.runs}


def held_runs(node: str, text: str, tokens: Tokens, preserve: tuple[re.Pattern, ...]) -> Iterator[Run]:
    """Runs of a stretch that isn't translated: preserved patterns, then identifiers, then the rest."""
    at = 0
    for a, b in [*free([m.span() for p in preserve for m in p.finditer(text)]), (len(text), len(text))]:
        if plain := text[at:a]:
            found = identifiers(plain)
            names = [tokens.new(plain[x:y], "S") for x, y in found]
            last = 0
            for (x, y), name in [*zip(found, names, strict=True), ((len(plain), len(plain)), "")]:
                if x > last:
                    yield Run(node, "english_protected", plain[last:x], tokens.new(plain[last:x], "E"))
                if name:
                    yield Run(node, "identifier_protected", plain[x:y], name)
                last = y
        if b > a:
            yield Run(node, "model_number_protected", text[a:b], tokens.new(text[a:b], "M"))
        at = b


def text_runs(node: str, text: str, tokens: Tokens, preserve: tuple[re.Pattern, ...] = ()) -> list[Run]:
    """Runs of a text node. White space around held stretches goes with what is translated."""
    out: list[Run] = []
    at = 0
    for m in [*MARKER.finditer(text), None]:
        stop = m.start() if m else len(text)
        piece = text[at:stop]
        if piece and not piece.strip():
            out += held_runs(node, piece, tokens, preserve)
        elif piece:
            last, plain = 0, not preserve and not HINT.search(piece)
            for h in HELD.finditer(piece):
                if h.start() > last:
                    out.append(Run(node, "chinese", piece[last : h.start()]))
                if plain:
                    out.append(Run(node, "english_protected", h[0], tokens.new(h[0], "E")))
                else:
                    out += held_runs(node, h[0], tokens, preserve)
                last = h.end()
            if last < len(piece):
                out.append(Run(node, "chinese", piece[last:]))
        if m:
            out.append(Run(node, "entity_protected", m[0], tokens.new(m[0], "E")))
            at = m.end()
    return out


def blocks(tree: Tree) -> list[list[tuple[str, Node]]]:
    """Items (start, end, text) of each block with text that isn't English only; excluded subtrees are left out."""
    out: list[list[tuple[str, Node]]] = [[]]
    stack: list[tuple[str, Node]] = [("visit", c) for c in reversed(tree.root.children)]
    while stack:
        what, n = stack.pop()
        if what == "border":
            out.append([])
        elif what == "end":
            out[-1].append((what, n))
        elif n.kind == "text":
            if n.text.strip():
                out[-1].append(("text", n))
        elif n.kind == "element" and not n.excluded:
            below = [("visit", c) for c in reversed(n.children)]
            if n.tag in BLOCKS:
                out.append([])
                stack += [("border", n), *below]
            else:
                out[-1].append(("start", n))
                stack += [("end", n), *below]
    return [b for b in out if any(k == "text" and HAN.search(n.text) for k, n in b)]


class TooLong(ValueError):
    """A unit that can't be divided doesn't fit the model's room."""


#: Tokens by which a prefix may take up more or less than its whole runs do, as its last one is cut.
UNSURE = 64


class Packer:
    """Fills segments with a block's runs."""

    def __init__(self, doc: str, room: int, cost: Callable[[str], int], preserve: tuple[re.Pattern, ...], translatable: frozenset[str]):
        self.doc, self.room, self.cost, self.preserve, self.translatable = doc, room, cost, preserve, translatable
        self.done: list[Segment] = []

    def block(self, key: str, items: list[tuple[str, Node]]) -> None:
        self.tokens, self.held, self.ready, self.place, first = Tokens(), [], "", 0, len(self.done)
        tags = [None if kind == "text" else start_tag(n, self.translatable) if kind == "start" else end_tag(n) for kind, n in items]
        names = [None if t is None else self.tokens.new(t, "T") for t in tags]
        text = "".join(n.text if t is None else t for (_, n), t in zip(items, tags, strict=True))
        self.key, self.whole = key, text
        for (_, n), tag, name in zip(items, tags, names, strict=True):
            if tag is None:
                self.text(n)
            else:
                if self.sending and not self.fits([Run("tag", "tag", tag, name)]):
                    self.flush()
                self.take([Run("tag", "tag", tag, name)])
        if self.sending:
            self.flush()
        elif self.held and len(self.done) > first:  # nothing more to translate: what is left ends the last segment
            last = self.done[-1]
            last.runs += self.held
            self.close(last)

    @property
    def sending(self) -> bool:
        return any(r.translate for r in self.held)

    def shown(self, runs: list[Run]) -> str:
        return spaced("".join(r.shown for r in runs))

    def fits(self, more: list[Run], alone: bool = False) -> bool:
        return self.cost(("" if alone else self.ready) + self.shown(more)) <= self.room

    def reach(self, node: Node, text: str, alone: bool = False) -> int:
        """How many characters of text fit: all, or the longest beginning (one character, of several, if none does).

        The runs of a stretch that is surely long enough are found once; what they take up together answers for all
        prefixes but those that end so near to the room's end that cutting their last run may matter.
        """
        before, width = "" if alone else self.ready, self.room // 4 + 64
        while True:
            runs = text_runs(node.id, text[:width], Tokens(), self.preserve)
            shown = [spaced(r.shown) for r in runs]
            if self.cost(before + "".join(shown)) > self.room + 4 * UNSURE or width >= len(text):
                break
            width *= 2
        whole = "".join(shown)
        if width >= len(text) and self.cost(before + whole) <= self.room:
            return len(text)
        ends, tops = [[0, *accumulate(map(len, x))] for x in ([r.raw for r in runs], shown)]

        def fits(n: int) -> bool:
            k = bisect_right(ends, n) - 1
            if k >= len(runs) and n > ends[-1]:
                return False
            least = tops[k] + (n - ends[k] if k < len(runs) and runs[k].translate else 0)
            if self.cost(before + whole[:least]) > self.room + UNSURE:
                return False
            if self.cost(before + whole[: tops[min(k + 1, len(runs))]]) + UNSURE <= self.room:
                return True
            while k and not (k < len(runs) and runs[k].translate and runs[k].raw[: n - ends[k]].strip()):
                k -= 1  # stretches before a translated run are the same however the text is cut after it
            return self.cost(before + whole[: tops[k]] + self.shown(text_runs(node.id, text[ends[k] : n], Tokens(), self.preserve))) <= self.room

        low, high = 1, len(text)
        while low < high:
            middle = low + (high - low + 1) // 2
            low, high = (middle, high) if fits(middle) else (low, middle - 1)
        return min(low, len(text) - 1)

    def take(self, runs: list[Run]) -> None:
        for r in runs:
            r.offset_start, r.offset_end = self.place, self.place + len(r.raw)
            self.place = r.offset_end
        self.held += runs
        self.ready += self.shown(runs)

    def close(self, s: Segment) -> None:
        slot = 0
        for i, r in enumerate(s.runs):
            r.sequence_index = i
            if r.translate:
                r.slot_index = slot
            else:
                slot += 1
        s.source_text, s.tokens = self.shown(s.runs), self.tokens.of
        s.token_count = self.cost(s.source_text)

    def flush(self) -> None:
        if self.sending:
            n = len(self.done)
            self.done.append(Segment(f"{self.doc}:{n:04d}", n, self.key, self.whole, "", 0, self.held))
            self.close(self.done[-1])
            self.held, self.ready = [], ""

    def text(self, node: Node) -> None:
        """Divide a text node: at the last end of a sentence that fits, else of a clause, else wherever it must be."""
        text, at = node.text, 0
        while at < len(text):
            if self.held and self.held[-1].translate:
                self.flush()
            rest = text[at:]
            most = self.reach(node, rest)
            if most < len(rest):
                cut = border(rest, beside(rest, most))
                self.flush()
                if not cut:
                    most = self.reach(node, rest, alone=True)  # tags that wait may make it a little longer
                    cut = most if most == len(rest) else forced(rest, most)
                    while not self.fits(text_runs(node.id, rest[:cut], Tokens(), self.preserve), alone=True):
                        # cut before a reference, white space is a run of its own: it may take up more than the longer text did
                        less = forced(rest, cut - 1) if cut > 1 else cut
                        if less >= cut:
                            raise TooLong(f"no prefix of node {node.id} fits {self.room} tokens")
                        cut = less
                most = cut
            self.take(text_runs(node.id, rest[:most], self.tokens, self.preserve))
            at += most


#: Up to the last end of a sentence; of a clause.
BORDERS = [re.compile(f"(?s).*[{re.escape(ends)}]") for ends in (P.SENTENCE_ENDS, P.CLAUSE_ENDS)]


def border(text: str, most: int) -> int:
    """The best place to divide text among its first ``most`` characters; 0 if there is none."""
    return next((m.end() for b in BORDERS if (m := b.match(text, 0, most))), 0)


def beside(text: str, cut: int) -> int:
    """The cut, if it falls into a character reference moved before it, or after one that begins the text."""
    inside = next(((m.start(), m.end()) for m in MARKER.finditer(text) if m.start() < cut < m.end()), None)
    return cut if inside is None else inside[0] or inside[1]


def forced(text: str, most: int) -> int:
    """The last place among the first ``most`` characters that isn't beside an underscore or in a character reference."""
    return beside(text, next((c for c in range(most, 1, -1) if "_" not in text[c - 1 : c + 1]), 1))


def segments(tree: Tree, doc: str, room: int = 450, cost: Callable[[str], int] = measure, preserve: tuple[str, ...] = (), translatable: tuple[str, ...] = ()) -> list[Segment]:
    """All segments of a document, in order; checked to cover their blocks."""
    packer = Packer(doc, room, cost, tuple(re.compile(p) for p in preserve), frozenset(translatable))
    for i, items in enumerate(blocks(tree)):
        packer.block(f"b{i:04d}", items)
    if bad := uncovered(packer.done):
        raise ValueError(f"runs do not cover {bad}")
    return packer.done


def uncovered(done: list[Segment]) -> list[str]:
    """Blocks of which some character lies in no run, or in another place than its run says."""
    bad = []
    for key, some in groupby(done, lambda s: s.block_key):
        some = list(some)
        text, place, fine = some[0].block_text, 0, True
        for r in chain.from_iterable(s.runs for s in some):
            fine &= r.offset_start == place and text[place : r.offset_end] == r.raw
            place = r.offset_end
        if not fine or place != len(text):
            bad.append(key)
    return bad


def attribute_segments(tree: Tree, doc: str, translatable: tuple[str, ...], room: int = 450, cost: Callable[[str], int] = measure) -> list[Segment]:
    """A segment for each allowed attribute value with Han characters; such values aren't cut."""
    out: list[Segment] = []
    for n in tree.walk():
        for name, value in n.attrs:
            if name in translatable and HAN.search(value):
                tokens, runs, last, where = Tokens(), [], 0, f"attr:{n.id}:{name}"
                for a, b in identifiers(value):
                    runs += [Run(where, "attribute", value[last:a])] * (a > last) + [Run(where, "identifier_protected", value[a:b], tokens.new(value[a:b], "S"))]
                    last = b
                runs += [Run(where, "attribute", value[last:])] * (last < len(value))
                text = "".join(r.shown for r in runs)
                if cost(text) > room:
                    raise TooLong(f"the value of {name} on {n.id} needs more than {room} tokens")
                s = Segment(f"attr:{doc}:{len(out):04d}", len(out), f"attr{len(out):04d}", value, text, cost(text), runs, tokens.of)
                slot = place = 0
                for i, r in enumerate(runs):
                    r.sequence_index, r.offset_start, place = i, place, place + len(r.raw)
                    r.offset_end = place
                    r.slot_index = slot if r.translate else None
                    slot += not r.translate
                out.append(s)
    return out


class Rejected(ValueError):
    """A translation that doesn't fit its source's structure; nothing of it is used."""


def pieces_of(segment: Segment, output: str) -> list[str]:
    """The output between its placeholders, which must be the segment's, each once, in their order, and no others."""
    if (found := [m[0] for m in ANY_TOKEN.finditer(output)]) != segment.order:
        raise Rejected(f"{segment.segment_id}: placeholders {found} are not {segment.order}")
    return TOKEN.split(output)


def edged(source: str, piece: str) -> str:
    lead = source[: len(source) - len(source.lstrip())]
    rest = source[len(lead) :]
    return lead + piece.strip() + rest[len(rest.rstrip()) :]


def merge(left: str, right: str) -> bool:
    """Whether two ASCII words would run into one."""
    return bool(re.search(r"[A-Za-z0-9]\Z", left) and re.match("[A-Za-z0-9]", right))


def rebuilt(tree: Tree, done: list[Segment], outputs: dict[str, str], attrs: list[Segment] = [], translatable: tuple[str, ...] = ()) -> str:  # noqa: B006
    """The document with its translated segments; rejected unless all but translated text is as it was."""
    before = tree.fingerprint(frozenset(translatable))
    kept = [(n, n.text) for n in tree.walk() if n.kind == "text" and n.excluded]
    new: dict[str, str] = {}
    guarded = set()
    for s in done:
        pieces = pieces_of(s, outputs[s.segment_id])
        for r in s.runs:
            if r.node_id == "tag":
                continue
            old = new.get(r.node_id, "")
            if r.translate:
                new[r.node_id] = old + edged(r.raw, pieces[r.slot_index])
            else:
                guarded.add(r.node_id)
                new[r.node_id] = old + (" " if merge(old, r.raw) else "") + r.raw
    last = None
    for n in tree.walk():
        if n.kind != "text":
            continue
        if n.id in new:
            joins = last is not None and last.id in new and (last.id in guarded or n.id in guarded) and merge(new[last.id], new[n.id])
            n.text = new[n.id] = (" " if joins else "") + new[n.id]
        last = n
    elements = {n.id: n for n in tree.walk() if n.kind == "element"}
    for s in attrs:
        pieces = pieces_of(s, outputs[s.segment_id])
        _, where, name = s.runs[0].node_id.split(":", 2)
        n = elements.get(where)
        if n is None or name not in translatable or name not in dict(n.attrs):
            raise Rejected(f"{s.segment_id}: no such attribute")
        value = "".join(edged(r.raw, pieces[r.slot_index]) if r.translate else r.raw for r in s.runs)
        n.attrs = [(k, value if k == name else v) for k, v in n.attrs]
        n.spelt_start = n.spelt_end = None
    if any(n.text != text for n, text in kept) or tree.fingerprint(frozenset(translatable)) != before:
        raise Rejected("the structure or a text that is never translated changed")
    return tree.serialized()


