"""Selectors over captured pages: CSS with the text conditions that browser automation adds, and a part of XPath.

``compile_selector`` turns both into one form: alternatives of steps, each a relation to the step before (descendant,
child, next or later sibling) and conditions. A step's conditions are met by a set of the page's elements whatever stands
before it, so a selector is evaluated step by step over whole sets: an element lies within another if its number lies
between those of the other's start and end. That takes time in proportion to the page (and a logarithm), however its
elements are nested or left open. Unknown forms raise ValueError when the plan is built.

A scope bounds what is found; ancestors that a CSS selector names may stand outside. XPath steps lead from the scope.
Text is that of the elements without scripts and styles.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style"))
XPATH_BLANKS = " \t\r\n"
# Which elements that begin end an open one, as HTML has it.
_GROUPS = ("tbody", "thead", "tfoot")
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_KEEPS_P = frozenset("applet button caption html marquee object table td template th".split())
ENDED_BY = {
    "li": ("li",),
    "td": ("td", "th", "tr", *_GROUPS),
    "th": ("td", "th", "tr", *_GROUPS),
    "tr": ("tr", *_GROUPS),
    **dict.fromkeys(_GROUPS, _GROUPS),
    "option": ("option", "optgroup"),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
}


def plain(text: str) -> str:
    """White space as single spaces, none at the ends."""
    return " ".join(text.split())


_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*(=?[^\s/>=]*)\s*")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in (*SILENT, "textarea", "title")}


class Page:
    """A page's elements, numbered as they begin; 0 is the page. Stray end tags are ignored; unclosed elements end with
    their parents, or where HTML ends them; rows of a table stand in a tbody. An unclosed tag or comment ends the page."""

    def __init__(self, html: str | None):
        self.tags, self.attrs, self.parent, self.end, self.begins, self.stops = ["#page"], [{}], [-1], [0], [0], [0]
        self.runs: list[list[str]] = [[]]  # each element's own stretches of text
        self.open, self.count = [0], {"#page": 1}
        self.texts: list[str] = []
        self.size = 0
        self.paragraphs = [0]  # open ones, for each open element that keeps those outside open
        self.apart = [False]  # whether the next text begins a new stretch
        self._read(html or "")
        while self.open:
            self._pop()
        self.text = "".join(self.texts)
        self._by: dict[tuple, list[int]] = {}
        self._sets: dict = {}

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            stop = html.find("<", at)
            if stop < 0:
                stop = n
            if stop > at:
                self._data(unescape(html[at:stop]))
            if stop == n:
                return
            tag = _TAG.match(html, stop)
            if tag is None:
                if html.startswith("<!--", stop):
                    at = html.find("-->", stop + 4) + 3
                elif html[stop + 1 : stop + 2] in ("!", "?", "/"):
                    at = html.find(">", stop) + 1
                else:
                    self._data("<")
                    at = stop + 1
                    continue
                if at < stop:
                    return
                self.apart[self.open[-1]] = True
                continue
            name = tag[2].lower()
            attrs, at = self._attributes(html, tag.end())
            if at < 0:
                return
            if tag[1]:
                self._end(name)
                continue
            self._start(name, attrs)
            if name in _RAW_END:
                found = _RAW_END[name].search(html, at)
                stop = found.start() if found else n
                self._data(unescape(html[at:stop]))
                at = stop

    @staticmethod
    def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
        """A tag's attributes, the first of a name, and the place after the tag; -1 if it doesn't end."""
        out: dict[str, str] = {}
        while True:
            m = _ATTRIBUTE.match(html, at)
            at, value = m.end(), ""
            if at >= len(html):
                return out, -1
            if html[at] == "=" and m[1]:
                at += 1
                while at < len(html) and html[at].isspace():
                    at += 1
                quote = html[at : at + 1]
                if quote in ("'", '"') and quote:
                    stop = html.find(quote, at + 1)
                    if stop < 0:
                        return out, -1
                    value, at = html[at + 1 : stop], stop + 1
                else:
                    own = re.compile(r"[^\s>]*").match(html, at)
                    value, at = own[0], own.end()
            if m[1]:
                out.setdefault(m[1].lower(), unescape(value))
            if html[at : at + 1] == ">":
                return out, at + 1

    def _pop(self) -> None:
        at = self.open.pop()
        tag = self.tags[at]
        self.count[tag] -= 1
        if tag == "p":
            self.paragraphs[-1] -= 1
        elif tag in _KEEPS_P:
            self.paragraphs.pop()
        self.end[at], self.stops[at] = len(self.tags), self.size

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        while tag in ENDED_BY.get(self.tags[self.open[-1]], ()):
            self._pop()
        if tag in _ENDS_P and self.paragraphs[-1]:
            self._end("p")
        if tag == "tr" and self.tags[self.open[-1]] == "table":
            self._start("tbody", {})
        at = len(self.tags)
        self.apart[self.open[-1]] = True
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.parent.append(self.open[-1])
        self.end.append(at + 1)
        self.begins.append(self.size)
        self.stops.append(self.size)
        self.runs.append([])
        self.apart.append(False)
        if tag not in VOID:
            self.open.append(at)
            self.count[tag] = self.count.get(tag, 0) + 1
            if tag == "p":
                self.paragraphs[-1] += 1
            elif tag in _KEEPS_P:
                self.paragraphs.append(0)

    def _end(self, tag: str) -> None:
        if self.count.get(tag):
            while self.tags[self.open[-1]] != tag:
                self._pop()
            self._pop()

    def _data(self, data: str) -> None:
        at = self.open[-1]
        if self.tags[at] in SILENT or not data:
            return
        self.texts.append(data)
        self.size += len(data)
        if self.apart[at] or not self.runs[at]:
            self.runs[at].append(data)
            self.apart[at] = False
        else:
            self.runs[at][-1] += data

    def inner_text(self, at: int) -> str:
        return self.text[self.begins[at] : self.stops[at]].strip()

    def having(self, kind: str, value: str) -> list[int]:
        """The elements of a tag, class or id, ascending."""
        if not self._by:
            by: dict[tuple, list[int]] = {("", ""): list(range(1, len(self.tags)))}
            for i in range(1, len(self.tags)):
                by.setdefault(("tag", self.tags[i]), []).append(i)
                if "id" in self.attrs[i]:
                    by.setdefault(("id", self.attrs[i]["id"]), []).append(i)
                for c in dict.fromkeys(self.attrs[i].get("class", "").split()):
                    by.setdefault(("class", c), []).append(i)
            self._by = by
        return self._by.get((kind, value), [])

    def places(self, of_type: bool) -> list[tuple[int, int]]:
        """(number among its siblings, how many these are) of every element, of all or of its own tag."""
        key = ("places", of_type)
        if key not in self._sets:
            seen: dict[tuple, int] = {}
            number = [0] * len(self.tags)
            for i in range(1, len(self.tags)):
                own = (self.parent[i], self.tags[i] if of_type else None)
                number[i] = seen[own] = seen.get(own, 0) + 1
            self._sets[key] = [(number[i], seen.get((self.parent[i], self.tags[i] if of_type else None), 0)) for i in range(len(self.tags))]
        return self._sets[key]

    def previous(self) -> list[int]:
        """The sibling before each element; -1 for the first."""
        if "previous" not in self._sets:
            last: dict[int, int] = {}
            out = [-1] * len(self.tags)
            for i in range(1, len(self.tags)):
                out[i] = last.get(self.parent[i], -1)
                last[self.parent[i]] = i
            self._sets["previous"] = out
        return self._sets["previous"]

    def collapsed(self, at: int, blanks: str | None = None) -> tuple[str, int, int]:
        """The page's text with white space (or the given blanks) as single spaces, and the element's stretch there
        without spaces at its ends."""
        if ("collapsed", blanks) not in self._sets:
            out, place, before = [], [], False
            for c in self.text:
                place.append(len(out))
                blank = c.isspace() if blanks is None else c in blanks
                if not (blank and before):
                    out.append(" " if blank else c)
                before = blank
            self._sets["collapsed", blanks] = "".join(out), [*place, len(out)]
        text, place = self._sets["collapsed", blanks]
        a, b = place[self.begins[at]], place[self.stops[at]]
        if a < b and text[a] == " ":
            a += 1
        if b > a and text[b - 1] == " ":
            b -= 1
        return text, a, b

    def holds(self, at: int, part: str, stretch: tuple[str, int, int], any_case: bool = False) -> bool:
        """Whether a stretch of the page's (collapsed) text holds ``part``, by the next place where the text does."""
        text, a, b = stretch
        if any_case:
            part = part.lower()
        key = ("holds", part, id(text), any_case)
        if key not in self._sets:
            if any_case:  # letter by letter, where lower case is of another length
                low = text.lower()
                text = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            places, k = [], text.find(part)
            while k >= 0:
                places.append(k)
                k = text.find(part, k + 1)
            self._sets[key] = places
        places = self._sets[key]
        k = bisect_left(places, a)
        return not part or k < len(places) and places[k] + len(part) <= b

    def has_text(self, at: int, value: str) -> bool:
        return self.tags[at] not in SILENT and self.holds(at, value, self.collapsed(at), True)


# --- The compiled form ----------------------------------------------------------------------------------------------
# Selector: tuple of alternatives. Alternative: tuple of steps (relation, conditions). Relation: " ", ">", "+" or "~".
# Condition: (name, *values), checked by _holds or, if it depends on an order among siblings that are left, by _numbered.


def _related(page: Page, found: list[int], before: list[int], relation: str) -> list[int]:
    """Those of ``found`` that stand in the relation to one of ``before``; both ascending."""
    if relation == " ":
        out, k, reach = [], 0, 0
        for i in found:
            while k < len(before) and before[k] < i:
                reach = max(reach, page.end[before[k]])
                k += 1
            if i < reach:
                out.append(i)
        return out
    if relation == ">":
        known = set(before)
        return [i for i in found if page.parent[i] in known]
    if relation == "+":
        known, previous = set(before), page.previous()
        return [i for i in found if previous[i] in known]
    first: dict[int, int] = {}
    for i in before:
        first.setdefault(page.parent[i], i)
    return [i for i in found if first.get(page.parent[i], i) < i]


def _leading(page: Page, start: list[int], found: list[int], relation: str) -> list[int]:
    """Those of ``start`` to which one of ``found`` stands in the relation."""
    if relation == " ":
        return [i for i in start if (k := bisect_right(found, i)) < len(found) and found[k] < page.end[i]]
    if relation == ">":
        known = {page.parent[i] for i in found}
        return [i for i in start if i in known]
    if relation == "+":
        previous = page.previous()
        known = {previous[i] for i in found}
        return [i for i in start if i in known]
    last = {page.parent[i]: i for i in found}
    return [i for i in start if last.get(page.parent[i], -1) > i]


def _inside(page: Page, start: list[int], alternative: tuple) -> list[int]:
    """Those of ``start`` from which the steps of ``alternative`` lead somewhere."""
    found = _meeting(page, alternative[-1][1])
    for k in range(len(alternative) - 1, 0, -1):
        found = _leading(page, _meeting(page, alternative[k - 1][1]), found, alternative[k][0])
    return _leading(page, start, found, alternative[0][0])


def _numbered(page: Page, found: list[int], test) -> list[int]:
    """Those whose number among the found ones of one parent passes ``test(number, count)``."""
    by: dict[int, list[int]] = {}
    for i in found:
        by.setdefault(page.parent[i], []).append(i)
    return sorted(i for group in by.values() for n, i in enumerate(group, 1) if test(n, len(group)))


def _nth(n: int, step: int, first: int) -> bool:
    return n == first if not step else (n - first) % step == 0 and (n - first) // step >= 0


def _attribute(own: str | None, op: str, value: str, any_case: bool) -> bool:
    if own is None:
        return False
    if any_case:
        own, value = own.lower(), value.lower()
    if op in ("^=", "$=", "*=") and not value:
        return False
    return {"": True, "=": own == value, "~=": value in own.split(), "|=": own == value or own.startswith(value + "-"), "^=": own.startswith(value), "$=": own.endswith(value), "*=": value in own}[op]


def _text_is(page: Page, at: int, value: str) -> bool:
    """Whether one of an element's own stretches of text is the value."""
    if page.tags[at] in SILENT:
        return False
    return any(plain(run) == value for run in page.runs[at]) or not value and not page.runs[at]


def _filtered(page: Page, found: list[int], condition: tuple) -> list[int]:
    name, *values = condition
    if name in ("tag", "class", "id"):
        known = set(page.having(name, values[0]))
        return [i for i in found if i in known]
    if name == "attribute":
        return [i for i in found if _attribute(page.attrs[i].get(values[0]), *values[1:])]
    if name == "nth":
        step, first, of_type, backwards = values
        places = page.places(of_type)
        return [i for i in found if _nth(places[i][1] + 1 - places[i][0] if backwards else places[i][0], step, first)]
    if name == "only":
        return [i for i in found if page.places(False)[i][1] == 1]
    if name == "has":
        kept = {i for alternative in values[0] for i in _inside(page, found, alternative)}
        return [i for i in found if i in kept]
    if name in ("is", "not"):
        known = set(_selected(page, values[0]))
        return [i for i in found if (i in known) == (name == "is")]
    if name == "text-is":
        return [i for i in found if _text_is(page, i, values[0])]
    if name == "has-text":
        return [i for i in found if page.has_text(i, values[0])]
    if name == "text":  # the smallest elements that hold it
        above = {page.parent[i] for i in page.having("", "") if page.has_text(i, values[0])}
        return [i for i in found if i not in above and page.has_text(i, values[0])]
    if name == "position":
        return _numbered(page, found, lambda n, count: n == (count if values[0] is None else values[0]))
    if name == "and":
        for one in values[0]:
            found = _filtered(page, found, one)
        return found
    if name == "or":
        kept = {i for one in values[0] for i in _filtered(page, found, one)}
        return [i for i in found if i in kept]
    if name == "unless":
        gone = set(_filtered(page, found, values[0]))
        return [i for i in found if i not in gone]
    if name == "value":
        return [i for i in found if _value(page, i, *values)]
    raise ValueError(f"unknown condition {name}")


def _value(page: Page, at: int, op: str, what: str, squeezed: bool, wanted: str) -> bool:
    """XPath: contains, starts-with or = of an element's text ('.'), own first text ('text()') or attribute ('@name')."""
    if what == ".":
        text, a, b = stretch = page.collapsed(at, XPATH_BLANKS) if squeezed else (page.text, page.begins[at], page.stops[at])
        if op == "contains":
            return page.holds(at, wanted, stretch)
        return (b - a == len(wanted) or op == "starts-with" and b - a > len(wanted)) and text.startswith(wanted, a)
    own = [page.attrs[at][what[1:]]] if what[1:] in page.attrs[at] else [] if what.startswith("@") else page.runs[at]
    if op == "=" and not squeezed:
        return wanted in own
    value = own[0] if own else ""
    if squeezed:
        value = " ".join(filter(None, re.split(f"[{XPATH_BLANKS}]+", value)))
    return value == wanted if op == "=" else value.startswith(wanted) if op == "starts-with" else wanted in value


def _meeting(page: Page, conditions: tuple) -> list[int]:
    """All elements of the page that meet a step's conditions; kept, as steps come again for every container."""
    if conditions not in page._sets:
        named = [c for c in conditions if c[0] in ("id", "class", "tag")]
        # Positions count what is left, so the order of conditions stays; only names can come first.
        found = min((page.having(*c) for c in named), key=len) if named else page.having("", "")
        for c in conditions:
            found = _filtered(page, found, c)
        page._sets[conditions] = found
    return page._sets[conditions]


def _selected(page: Page, selector: tuple, scope: int = 0, within: bool = False) -> list[int]:
    """Ascending; with ``within`` the first step leads from the scope, and all must."""
    out: set[int] = set()
    for alternative in selector:
        found = None
        for relation, conditions in alternative:
            here = _meeting(page, conditions)
            found = _related(page, here, [scope] if found is None else found, relation) if within or found is not None else here
        out.update(found or ())
    return sorted(out)


def select(page: Page, selector: tuple[bool, tuple], scope: int = 0) -> list[int]:
    """The elements within ``scope`` that a compiled selector finds, in page order."""
    within, alternatives = selector
    if within:
        return _selected(page, alternatives, scope, True)
    if ("all", alternatives) not in page._sets:
        page._sets["all", alternatives] = _selected(page, alternatives)
    found = page._sets["all", alternatives]
    return found[bisect_right(found, scope) : bisect_left(found, page.end[scope])]


# --- CSS ------------------------------------------------------------------------------------------------------------

_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_STRING = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"
_TOKEN = re.compile(rf"\s*([>+~,])\s*|(\s+)|\.({_NAME})|#({_NAME})|\[\s*({_NAME})\s*(?:([~|^$*]?=)\s*({_STRING}|[^\]\s]+)\s*([iIsS])?\s*)?\]|:({_NAME})(\()?|(\*|{_NAME})")
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$")


def _bare(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _string(text: str) -> str:
    text = text.strip()
    return _bare(text[1:-1]) if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1 else text


def _argument(text: str, at: int) -> tuple[str, int]:
    """What stands between a bracket that has just opened and its end, and the place after it."""
    start, depth = at, 1
    for m in re.compile(rf"{_STRING}|[()]").finditer(text, at):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth:
            return text[start : m.start()], m.end()
    raise ValueError(f"no closing bracket in {text}")


def _nth_condition(argument: str, of_type: bool, backwards: bool) -> tuple:
    m = _NTH.match(argument)
    if not m:
        raise ValueError(f"unknown position {argument}")
    if m[1]:
        return "nth", 2, int(m[1] == "odd"), of_type, backwards
    if m[5]:
        return "nth", 0, int(m[5]), of_type, backwards
    step = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
    return "nth", step, int((m[3] or "+") + (m[4] or "0")), of_type, backwards


def _pseudo(name: str, argument: str | None) -> tuple:
    if argument is None:
        known = {"first-child": ("nth", 0, 1, False, False), "last-child": ("nth", 0, 1, False, True), "first-of-type": ("nth", 0, 1, True, False), "last-of-type": ("nth", 0, 1, True, True), "only-child": ("only",)}
        if name in known:
            return known[name]
    elif name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        return _nth_condition(argument, name.endswith("of-type"), "last" in name)
    elif name in ("has", "is", "where", "not"):
        return {"where": "is"}.get(name, name), _css(argument, name == "has")
    elif name in ("text", "text-is", "has-text"):
        return name, plain(_string(argument))
    raise ValueError(f"unknown selector :{name}" + ("" if argument is None else "()"))


def _css(text: str, relative: bool = False) -> tuple:
    alternatives, steps, conditions, at, text = [], [], [], 0, text.strip()
    relation: str | None = " "

    def step() -> None:
        nonlocal conditions
        if not conditions or relation is None:
            raise ValueError(f"incomplete selector {text}")
        steps.append((relation, tuple(conditions)))
        conditions = []

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"unknown selector at {text[at:]}")
        at = m.end()
        sign, space, cls, own_id, attribute, op, value, case, pseudo, bracket, tag = m.groups()
        if sign == ",":
            step()
            alternatives.append(tuple(steps))
            steps, relation = [], " "
        elif sign and not conditions and not steps and relative:
            relation = sign
        elif sign or space:
            step()
            relation = sign or " "
        elif cls:
            conditions.append(("class", _bare(cls)))
        elif own_id:
            conditions.append(("id", _bare(own_id)))
        elif attribute:
            conditions.append(("attribute", attribute.lower(), op or "", _string(value or ""), (case or "").lower() == "i"))
        elif pseudo:
            argument = None
            if bracket:
                argument, at = _argument(text, at)
            conditions.append(_pseudo(pseudo.lower(), argument))
        elif conditions:
            raise ValueError(f"a name within a step: {text}")
        else:
            conditions.append(("and", ()) if tag == "*" else ("tag", _bare(tag).lower()))
    step()
    return (*alternatives, tuple(steps))


# --- XPath ----------------------------------------------------------------------------------------------------------

_XPATH = re.compile(rf"\s*({_STRING}|//|\.//|\./|[/\[\]()|,=]|@[\w-]+|\.|\d+|[\w-]+(?:\(\))?|\*)")


class _XPath:
    """Paths of child and descendant steps; predicates of numbers, last(), paths, =, contains, starts-with, normalize-space, not, and, or."""

    def __init__(self, text: str):
        self.text, self.tokens, self.at, place = text, [], 0, 0
        while place < len(text.rstrip()):
            m = _XPATH.match(text, place)
            if not m:
                raise ValueError(f"unknown XPath at {text[place:]}")
            self.tokens.append(m[1])
            place = m.end()

    def next(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.next()
        if wanted and token not in wanted or not token:
            raise ValueError(f"unknown XPath {self.text} at {token or 'its end'}")
        self.at += 1
        return token

    def union(self) -> tuple:
        out = [self.path()]
        while self.next() == "|":
            self.take()
            out.append(self.path())
        if self.next():
            self.take("")
        return tuple(out)

    def path(self) -> tuple:
        steps, relation = [], ">"
        if self.next() in ("//", ".//", "/", "./"):
            relation = " " if self.take() in ("//", ".//") else ">"
        while True:
            steps.append((relation, self.step()))
            if self.next() not in ("/", "//"):
                return tuple(steps)
            relation = " " if self.take() == "//" else ">"

    def step(self) -> tuple:
        name = self.take()
        if not re.fullmatch(r"\*|[a-zA-Z][\w-]*", name):
            raise ValueError(f"unknown XPath step {name} in {self.text}")
        conditions = [("and", ()) if name == "*" else ("tag", name.lower())]
        while self.next() == "[":
            self.take()
            conditions.append(self.either())
            self.take("]")
        return tuple(conditions)

    def either(self) -> tuple:
        out = [self.both()]
        while self.next() == "or":
            self.take()
            out.append(self.both())
        return out[0] if len(out) == 1 else ("or", tuple(out))

    def both(self) -> tuple:
        out = [self.one()]
        while self.next() == "and":
            self.take()
            out.append(self.one())
        return out[0] if len(out) == 1 else ("and", tuple(out))

    def one(self) -> tuple:
        token = self.next()
        if token.isdigit():
            return "position", int(self.take())
        if token == "last()":
            self.take()
            return ("position", None)
        if token == "position()":
            self.take()
            self.take("=")
            return "position", None if self.next() == "last()" and self.take() else int(self.take())
        if token == "(":
            self.take()
            inner = self.either()
            self.take(")")
            return inner
        if token == "not":
            self.take()
            self.take("(")
            inner = self.either()
            self.take(")")
            return "unless", inner
        if token in ("contains", "starts-with"):
            self.take()
            self.take("(")
            what, squeezed = self.operand()
            self.take(",")
            wanted = self.literal()
            self.take(")")
            return "value", token, what, squeezed, wanted
        if token in (".//", "./") or re.fullmatch(r"\*|[a-zA-Z][\w-]*", token) and token != "normalize-space":
            return "has", (self.path(),)
        what, squeezed = self.operand()
        if self.next() == "=":
            self.take()
            return "value", "=", what, squeezed, self.literal()
        if what.startswith("@") and not squeezed:
            return "attribute", what[1:].lower(), "", "", False
        raise ValueError(f"unknown XPath condition in {self.text}")

    def operand(self) -> tuple[str, bool]:
        token = self.take()
        if token == "normalize-space()":
            return ".", True
        if token == "normalize-space":
            self.take("(")
            what, _ = self.operand()
            self.take(")")
            return what, True
        if token in (".", "text()") or token.startswith("@"):
            return token.lower(), False
        raise ValueError(f"unknown XPath value {token} in {self.text}")

    def literal(self) -> str:
        token = self.take()
        if token[0] not in "\"'":
            raise ValueError(f"a text is wanted in {self.text}, not {token}")
        return token[1:-1]


def compile_selector(text: str) -> tuple[bool, tuple]:
    """(whether steps lead from the scope, the alternatives) of a CSS selector, or of an XPath (``xpath=``, or from / or ./)."""
    text = text.strip()
    if text.startswith("xpath=") or text.startswith(("/", "./", "(")):
        return True, _XPath(text.removeprefix("xpath=")).union()
    return False, _css(text.removeprefix("css="))
