"""Facts of Python syntax trees: one parse of each file at most, everything else is relational.

A row is a fact: kind, a name, numbers a to d, a text key, and seq, the fact's place in a
breadth-first walk of the file.

    parse_error                                         the file has no tree, and no other fact
    module       a complexity, b functions, c classes
    function     name, a lines, b parameters, c complexity, d nesting, key of its body, null where no other of the file has it
    imported     name bound by an import                used         name read or written
    loaded       name read                              assigned     name assigned to
    called       bare name called
    import       name, a statement, c place             from         name (module), a statement, b level, c place, key the symbol

Four more a caller may ask for: size is a file's lines (a), complexity (b, by the tree or by keywords), and
functions and classes (c and d, null without a tree). secret is a rule that the text matches (seq its place, name its type, a
the number of matches), whether or not it has a tree. The others are parts of kinds: notable gives the functions that have a key or
are beyond one of LIMITS, unused the names imported but not used, and those assigned to but not loaded.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import zip_longest
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from quernel.functions.lexical import CONDITIONALS, LOOPS
from quernel.functions.secrets import matches, matches_by_lines
from quernel.plans.shared import ship

SCHEMA = "repo_id string, path string, seq int, kind string, name string, a int, b int, c int, d int, key string"
KINDS = frozenset(("parse_error", "module", "function", "imported", "used", "loaded", "assigned", "called", "import", "from"))
#: Lines, parameters, complexity and nesting up to which a function isn't notable.
LIMITS = (50, 5, 10, 6)
#: Kinds that go by the sums of a file.
_whole = frozenset(("module", "size"))
_KEYWORDS = re.compile(rf"\b(?:{'|'.join((*LOOPS, *CONDITIONALS))})\b")
#: Kinds of which a file has each name once, where it first stands.
_ONCE = frozenset(("imported", "used", "loaded", "assigned", "called"))
_COUNTED = frozenset((ast.If, ast.For, ast.While, ast.Try, ast.ExceptHandler, ast.With))
_PLUS_ONE = frozenset((ast.If, ast.For, ast.While, ast.IfExp))
_COMPREHENSIONS = frozenset((ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp))
_WEIGHED = _PLUS_ONE | _COMPREHENSIONS | {ast.Try, ast.BoolOp, ast.Match}
#: Fields of nodes that never hold nodes, and what tells nodes of a class apart.
_PLAIN = frozenset(("id", "attr", "asname", "module", "level", "type_comment", "kind", "is_async", "simple", "conversion"))
_OWN = {ast.Name: "id", ast.Constant: "value", ast.Attribute: "attr"}
_FIELDS: dict[type, tuple[str, ...]] = {ast.Constant: (), ast.alias: (), ast.Global: (), ast.Nonlocal: ()}


def _walked(tree: ast.AST) -> tuple[list[ast.AST], list[int], list[int]]:
    """The nodes breadth first, where each one's parent is, and where its children begin; they end where
    those of the next node begin."""
    nodes, up, first = [tree], [0], []
    for k, node in enumerate(nodes):
        first.append(len(nodes))
        cls = type(node)
        fields = _FIELDS.get(cls)
        if fields is None:
            fields = _FIELDS[cls] = tuple(f for f in cls._fields if f not in _PLAIN)
        for f in fields:
            x = getattr(node, f, None)
            if isinstance(x, list):
                below = [y for y in x if isinstance(y, ast.AST)]
                nodes += below
                up += [k] * len(below)
            elif isinstance(x, ast.AST):
                nodes.append(x)
                up.append(k)
    first.append(len(nodes))
    return nodes, up, first


def _weight(node: ast.AST) -> int:
    cls = type(node)
    if cls in _PLUS_ONE:
        return 1
    if cls is ast.Try:
        return len(node.handlers)
    if cls is ast.BoolOp:
        return len(node.values) - 1
    return len(node.generators) if cls in _COMPREHENSIONS else len(node.cases)


class _Piece:
    """What is known of statements: how many nodes stand on each level below the module, facts as (level,
    place on it, kind, name, a, b, c, d, key), those of them that may be told where no two bodies agree,
    the pieces that it is made of, marks and, where needed, keys of its functions' bodies, and names loaded
    and used where only names without them are told. times counts marks where two of the piece agree."""

    __slots__ = ("text", "levels", "rows", "few", "parts", "marks", "times", "keys", "loads", "uses", "complexity", "functions", "classes")

    def body_key(self, nth: int) -> str:
        if self.keys[nth] is None and self.parts:
            at = nth
            for p in self.parts:
                if at < len(p.marks):
                    self.keys[nth] = p.body_key(at)
                    break
                at -= len(p.marks)
        if self.keys[nth] is None:
            nodes = _walked(_tree(self.text))[0]
            self.keys = [_body_key(n) for n in nodes if type(n) is ast.FunctionDef]
        return self.keys[nth]


def _body_key(function: ast.FunctionDef) -> str:
    return hashlib.md5("".join(map(ast.dump, function.body)).encode()).hexdigest()


#: Where a statement that isn't indented begins.
_BETWEEN = re.compile(r"\n(?=(?!(?:else|elif|except|finally)\b)[A-Za-z_@])")
_DEFINED = re.compile(r"^(?:def|class|async)\b", re.M)
#: Lines after a statement that are empty or comments.
_AFTER = re.compile(r"(?:\n(?:#[^\n]*)?)+\Z")
#: A line in which names that end in digits, as in import m1, may be others without other facts but for the
#: names; such names; and what stands for them, which is such a name itself, so that no other is taken for it.
_SIMPLE = re.compile(r"(?!(?:def|class|async)\b)(?!.*(?: \.|\. |\._))[A-Za-z_][\w.,()\[\]=+ -]*", re.A)
_NUMBERED = re.compile(r"(?<![\w.])[A-Za-z_]+[0-9]+(?!\w)", re.A)
_STANDIN = re.compile(r"(?<![\w.])_([0-9]+)(?!\w)", re.A)
#: Such lines, some with strings in which no name stands that is told.
_STRINGS = r"""[A-Za-z_](?:[\w.,()\[\]=+ -]++|"[ !#-\[\]-z|~]*+"|'[ -&(-\[\]-z|~]*+')*+"""
_SIMPLE_LINES = re.compile(rf"(?!(?s:.*?)(?: \.|\. |\._))(?:(?!(?:def|class|async)\b){_STRINGS}(?:\n|\Z))++", re.A)
#: Where the first definition begins.
_FIRST = re.compile(r"\n(?=(?:class|def)\b)")
_QUOTES = ('"""', "'''")
#: A worker remembers statements up to a length that it has met twice, so many for each choice of kinds.
_LONGEST, _MOST = 4096, 20_000
_known: dict[frozenset[str], tuple[dict[str, _Piece], set[int]]] = {}
#: Comments to the end of a file that a worker has met, and how many it remembers.
_comments: set[str] = set()
_MOST_COMMENTS = 1000


def _statements(text: str) -> list[str]:
    """The text cut at ends of lines, into statements in all likelihood, without comments after them. Where
    such a comment is none, as within a string, what is before it can't be parsed alone."""
    whole = _cut(text)
    return [_without_comments(x) for x in whole] if "\n#" in text else whole


def _without_comments(text: str) -> str:
    # Counts are faster than the pattern and enough where no line is empty.
    if (at := text.find("\n#")) >= 0 and (text.count("\n#", at) == text.count("\n", at) or _AFTER.match(text, at)):
        return text[:at]
    return text


def _divided(text: str) -> list[str] | None:
    """What is before the first definition, classes to the first function, what is from there on, and the
    comments after it; None without a definition. Fewer differ of shorter parts."""
    if not (m := _FIRST.search(text)):
        return None
    rest, after = text[m.end() :], ""
    if (at := rest.find("\n#")) >= 0 and _only_comments(rest[at:]):
        rest, after = rest[:at], rest[at:]
    else:
        rest = rest.removesuffix("\n")
    at = rest.find("\ndef ")
    if at < 0 or rest.startswith("def"):
        return [text[: m.start()], rest, after]
    return [text[: m.start()], rest[:at], rest[at + 1 :], after]


def _only_comments(text: str) -> bool:
    if text in _comments:
        return True
    if text.count("\n#") + text.endswith("\n") != text.count("\n") and not _AFTER.match(text):
        return False
    if len(text) <= _LONGEST:
        if len(_comments) >= _MOST_COMMENTS:
            _comments.clear()
        _comments.add(text)
    return True


def _cut(text: str) -> list[str]:
    out = _BETWEEN.split(text.removesuffix("\n"))
    quotes = [q for q in _QUOTES if q in text]
    if not quotes and "@" not in text:
        return out
    whole, part = [], []
    for x in out:
        part.append(x)
        piece = "\n".join(part)
        if not (piece.startswith("@") and not _DEFINED.search(piece) or any(piece.count(q) % 2 for q in quotes)):
            whole.append(piece)
            part = []
    return [*whole, "\n".join(part)] if part else whole


def _parsed(text: str, kinds: frozenset[str], parts: list[str] | None) -> list[_Piece]:
    """The text in pieces. If each can be parsed alone, the whole has their statements one after the other,
    as none begins within a line or an indented block. What was not met before is parsed together, and
    definitions that were met twice one after the other are one piece. parts: the text divided."""
    known, met = _known.setdefault(kinds, ({}, set()))
    if parts is None or _joins_statements(parts[0]) or any(x not in known and _joins_statements(x) for x in parts[1:-1]):
        return _pieces(_statements(text), known, met, kinds)
    out = _simple(parts[0], known, met, kinds) or _pieces(_statements(parts[0]), known, met, kinds)
    for part in parts[1:-1]:
        part = _without_comments(part)
        piece = known.get(part)
        if piece is not None:
            out.append(piece)
            continue
        some = _pieces(_statements(part), known, met, kinds)
        if (mark := hash(part)) not in met:
            met.add(mark)
        elif len(part) <= _LONGEST and len(some) > 1:
            if len(known) >= _MOST:
                known.clear()
            some = [known.setdefault(part, _merged(some, part, kinds))]
        out += some
    return out


def _joins_statements(text: str) -> bool:
    """Whether what looks like two statements may be one."""
    return "@" in text or any(q in text for q in _QUOTES)


def _merged(pieces: list[_Piece], text: str, kinds: frozenset[str]) -> _Piece:
    """Pieces one after the other as one."""
    out = _Piece()
    out.text, out.levels, out.rows, out.marks, out.keys, out.loads, out.uses = text, [], [], [], [], set(), set()
    out.complexity, out.functions, out.classes = (sum(getattr(p, x) for p in pieces) for x in ("complexity", "functions", "classes"))
    times = out.times = _times([m for p in pieces for m in p.marks])
    for p in pieces:
        before = out.levels
        out.rows += [(r[0], r[1] + (before[r[0]] if r[0] < len(before) else 0), *r[2:]) for r in p.rows]
        out.levels = [a + b for a, b in zip_longest(before, p.levels, fillvalue=0)]
        out.keys += [p.body_key(k) if times and times[m] > 1 else None for k, m in enumerate(p.marks)]
        out.marks += p.marks
        out.loads |= p.loads
        out.uses |= p.uses
    out.parts, out.few = pieces, _few(out.rows, kinds)
    return out


def _pieces(statements: list[str], known: dict[str, _Piece], met: set[int], kinds: frozenset[str]) -> list[_Piece]:
    out, run = [], []
    for x in statements:
        piece = known.get(x)
        if piece is None and _SIMPLE.fullmatch(x):
            piece = _like(x, known, kinds)
        if piece is None:
            if (mark := hash(x)) not in met:
                met.add(mark)
            elif len(x) <= _LONGEST:
                piece = _piece(x, kinds)
                if len(known) >= _MOST:
                    known.clear()
                known[x] = piece
        if piece is None:
            run.append(x)
            continue
        if run:
            out.append(_piece("\n".join(run), kinds))
            run = []
        out.append(piece)
    if run:
        out.append(_piece("\n".join(run), kinds))
    if len(met) > 10 * _MOST:
        met.clear()
    return out


def _like(text: str, known: dict[str, _Piece], kinds: frozenset[str]) -> _Piece | None:
    """What is known of a simple line from one that is the same but for numbered names."""
    names: dict[str, str] = {}
    shape = _NUMBERED.sub(lambda m: names.setdefault(m[0], f"_{len(names)}"), text)
    if not names:
        return None
    like = known.get(shape)
    if like is None:
        if len(known) >= _MOST:
            known.clear()
        like = known[shape] = _piece(shape, kinds)
    return _renamed(like, list(names))


def _simple(text: str, known: dict[str, _Piece], met: set[int], kinds: frozenset[str]) -> list[_Piece] | None:
    """Simple lines as one piece, from lines that are the same but for numbered names and were met twice."""
    if len(text) > _LONGEST or not _SIMPLE_LINES.fullmatch(text):
        return None
    names: dict[str, str] = {}
    shape = _NUMBERED.sub(lambda m: names.setdefault(m[0], f"_{len(names)}"), text)
    like = known.get(shape)
    if like is None:
        if (mark := hash(shape)) not in met:
            met.add(mark)
            return None
        if len(known) >= _MOST:
            known.clear()
        like = known[shape] = _piece(shape, kinds)
    return [_renamed(like, list(names))]


def _renamed(like: _Piece, own: list[str]) -> _Piece:
    """A piece with names of its own in place of those that stand for them."""
    if not own or not (like.rows or like.loads or like.uses):
        return like
    names = {f"_{k}": name for k, name in enumerate(own)}

    def back(name: str | None) -> str | None:
        if name is None or "_" not in name:
            return name
        return names[name] if name in names else _STANDIN.sub(lambda m: own[int(m[1])], name)

    out = _Piece()
    out.text, out.levels, out.parts, out.marks, out.times, out.keys = like.text, like.levels, like.parts, like.marks, like.times, like.keys
    out.complexity, out.functions, out.classes = like.complexity, like.functions, like.classes
    out.rows = out.few = [(*r[:3], back(r[3]), *r[4:8], back(r[8])) for r in like.rows]
    out.loads, out.uses = {back(n) for n in like.loads}, {back(n) for n in like.uses}
    return out


def _times(marks: list[int]) -> dict[int, int]:
    """How often each mark is there, where two agree."""
    return Counter(marks) if len(set(marks)) < len(marks) else {}


def facts(text: str, kinds: frozenset[str] = KINDS) -> list[tuple]:
    """(seq, kind, name, a, b, c, d, key) of one file; a file that cannot be parsed has parse_error alone,
    and secrets where they are asked for. Statements that a worker remembers aren't parsed again."""
    parts = _divided(text)
    out = _of_tree(text, kinds, parts)
    if "size" in kinds:
        tree = out[0][3:6] if out and out[0][1] == "module" else (_keywords(text) + 1, None, None)
        out[: len(out) and out[0][1] == "module" and "module" not in kinds] = []
        out.append((0, "size", None, _lines(text), *tree, None))
    if "secret" in kinds:
        found = matches(text) if parts is None else matches_by_lines(*parts)
        out += [(k, "secret", kind, n, None, None, None, None) for k, kind, n in found]
    return out


def _lines(text: str) -> int:
    if text.isascii() and not any(x in text for x in "\r\x0b\x0c\x1c\x1d\x1e"):
        return text.count("\n") + (text[-1:] not in ("", "\n"))
    return len(text.splitlines())


def _keywords(text: str) -> int:
    return len(_KEYWORDS.findall(text))


def _of_tree(text: str, kinds: frozenset[str], parts: list[str] | None) -> list[tuple]:
    try:
        # Other line ends, and imports that change the grammar, are for the parser alone.
        if "\r" not in text and "\0" not in text and "__future__" not in text:
            if not text.isascii():
                text.encode()
            try:
                return _joined(_parsed(text, kinds, parts), kinds)
            except SyntaxError:
                pass
        return _joined([_piece(text, kinds)], kinds)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(0, "parse_error", None, None, None, None, None, None)] if "parse_error" in kinds else []


def _tree(text: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text)


def _functions(nodes: list[ast.AST], up: list[int], first: list[int], at: list[int]) -> tuple[list[tuple], list[int]]:
    """(name, a, b, c, d) of the functions at some places, and marks of their bodies, which agree where
    bodies do. What is below a node is summed up from the leaves."""
    counted, height, mark = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        cls, p = type(nodes[k]), up[k]
        mark[k] += hash(cls)
        if cls in _OWN:
            mark[k] += hash(getattr(nodes[k], _OWN[cls]))
        mark[p] += mark[k]
        counted[p] += counted[k] + (cls in _COUNTED)
        if height[k] >= height[p]:
            height[p] = height[k] + 1
    marks = [sum(mark[j] for j in range(first[k], first[k + 1]) if isinstance(nodes[j], ast.stmt)) for k in at]
    return [(n.name, (n.end_lineno or n.lineno) - n.lineno + 1, len(n.args.args), 1 + counted[k], height[k]) for k in at for n in (nodes[k],)], marks


def _piece(text: str, kinds: frozenset[str]) -> _Piece:
    rows, seen, loads, uses = [], set(), set(), set()
    once_kinds = kinds | {"assigned", "imported"} if "unused" in kinds else kinds
    nodes, up, first = _walked(_tree(text))
    complexity, functions, classes = 1, [], 0

    def once(kind: str, name: str) -> None:
        if kind in once_kinds and (kind, name) not in seen:
            seen.add((kind, name))
            rows.append((seq, kind, name, None, None, None, None, None))

    for seq, n in enumerate(nodes):
        cls = type(n)
        if cls is ast.Name:
            once("used", n.id)
            uses.add(n.id)
            if isinstance(n.ctx, ast.Load):
                once("loaded", n.id)
                loads.add(n.id)
        elif cls in _WEIGHED:
            complexity += _weight(n)
        elif cls is ast.FunctionDef:
            functions.append(seq)
        elif cls is ast.ClassDef:
            classes += 1
        elif cls is ast.Assign:
            for t in n.targets:
                if isinstance(t, ast.Name):
                    once("assigned", t.id)
        elif cls is ast.Call:
            if isinstance(n.func, ast.Name):
                once("called", n.func.id)
        elif cls is ast.Import or cls is ast.ImportFrom:
            for k, x in enumerate(n.names):
                once("imported", x.asname or x.name)
                if cls is ast.ImportFrom:
                    if "from" in kinds:
                        rows.append((seq, "from", n.module or "", None, n.level, k, None, x.name))
                elif "import" in kinds:
                    rows.append((seq, "import", x.name, None, None, k, None, None))
    out = _Piece()
    out.text, out.marks, out.times, out.keys, out.parts = text, [], {}, [], None
    out.complexity, out.functions, out.classes = complexity - 1, len(functions), classes
    out.loads, out.uses = (loads, uses) if "unused" in kinds else (set(), set())
    if functions and ("function" in kinds or "notable" in kinds):
        own, out.marks = _functions(nodes, up, first, functions)
        times = out.times = _times(out.marks)
        out.keys = [_body_key(nodes[k]) if times and times[m] > 1 else None for k, m in zip(functions, out.marks)]
        rows = sorted([(k, "function", *f, None) for k, f in zip(functions, own)] + rows, key=lambda r: r[0])
    if "unused" in kinds:
        without = {kind: names for kind, names in (("assigned", loads), ("imported", uses)) if kind not in kinds}
        rows = [r for r in rows if r[1] not in without or r[2] not in without[r[1]]]
    # From places in the walk to levels and places on them.
    out.levels, out.rows = [], []
    at, low, high = 0, 1, len(nodes) if len(first) < 2 else first[1]
    while low < high:
        while at < len(rows) and rows[at][0] < high:
            out.rows.append((len(out.levels), rows[at][0] - low, *rows[at][1:]))
            at += 1
        out.levels.append(high - low)
        low, high = first[low], first[high]
    out.few = _few(out.rows, kinds)
    return out


def _few(rows: list[tuple], kinds: frozenset[str]) -> list[tuple]:
    return rows if "function" in kinds else [r for r in rows if r[2] != "function" or _notable(r)]


def _notable(row: tuple) -> bool:
    """A function with a key, or beyond one of LIMITS."""
    return row[8] is not None or any(x > most for x, most in zip(row[4:8], LIMITS))


def _told(pieces: list[_Piece], kinds: frozenset[str]) -> Iterator[tuple[int, tuple]]:
    """Places of pieces and those of their facts that the kinds ask for."""
    marked = [p for p in pieces if p.marks]
    times = marked[0].times if len(marked) == 1 else _times([m for p in marked for m in p.marks])
    without = {}
    if "unused" in kinds:
        found = {r[2] for p in pieces for r in p.few}
        for kind, names in (("assigned", "loads"), ("imported", "uses")):
            if kind in found and kind not in kinds:
                without[kind] = set().union(*(getattr(p, names) for p in pieces))
    for k, p in enumerate(pieces):
        nth = 0
        for r in p.rows if times else p.few:
            if r[2] == "function":
                if times:
                    if times[p.marks[nth]] > 1:
                        r = (*r[:8], p.body_key(nth))
                    nth += 1
                    if "function" not in kinds and not _notable(r):
                        continue
            elif r[2] in without and r[3] in without[r[2]]:
                continue
            yield k, r


def _joined(pieces: list[_Piece], kinds: frozenset[str]) -> list[tuple]:
    """The facts of a file that is some pieces one after the other."""
    told = list(_told(pieces, kinds))
    if not told:
        return [_module(pieces)] if _whole & kinds else []
    depth = max((r[0] for _, r in told), default=-1) + 1
    places = [sum(n) for n in zip_longest(*(p.levels[:depth] for p in pieces), fillvalue=0)] if depth else []
    start = 1
    for level, n in enumerate(places):
        places[level], start = start, start + n
    rows, at = [], 0
    for piece, (level, k, kind, name, a, b, c, d, key) in told:
        while at < piece:
            for x, n in enumerate(pieces[at].levels[:depth]):
                places[x] += n
            at += 1
        seq = places[level] + k
        if kind == "import" or kind == "from":
            a = seq
        rows.append((seq, kind, name, a, b, c, d, key))
    out, seen = [], set()
    rows.sort(key=itemgetter(0))
    for r in rows:
        if r[1] in _ONCE:
            if r[1:3] in seen:
                continue
            seen.add(r[1:3])
        out.append(r)
    if _whole & kinds:
        out.insert(0, _module(pieces))
    return out


def _module(pieces: list[_Piece]) -> tuple:
    return (0, "module", None, 1 + sum(p.complexity for p in pieces), sum(p.functions for p in pieces), sum(p.classes for p in pieces), None, None)


def ast_facts(files: DataFrame, kinds: Iterable[str] = KINDS) -> DataFrame:
    """The facts of files (repo_id, path, text), of some kinds alone where a caller needs no others."""
    ship(files.sparkSession)
    wanted = frozenset(kinds)
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 4, pa.string())
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                rows = [(r, p, *f) for r, p, t in zip(*(part.column(i).to_pylist() for i in range(3))) for f in facts(t or "", wanted)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.select("repo_id", "path", "text").mapInArrow(run, SCHEMA)
