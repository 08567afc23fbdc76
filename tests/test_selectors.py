"""Selectors: pages written for each form, and a plain evaluation element by element of random pages."""

import random
import time
import xml.etree.ElementTree as ET

import pytest

from bidloom.config import Variable
from bidloom.operators import extract
from bidloom.operators.selectors import Page, compile_selector, select

CARDS = """<div class="List-sc-1 x"><div><div class="Main-sc-2"><a class="Num" href="/need/1">№ 1</a></div>
<span class="E">a</span><span class="E">открыт</span><span class="E">Стулья</span></div>
<div class="banner">ad</div><p><div><div class="Main-sc-2"><a class="Num" href="/need/2">№ 2</a></div></div></div>"""
DETAIL = """<div class="LV-0"><label>Заказчик</label><div> ГБУ <a href='/companyProfile/customer/7'>Ромашка</a></div></div>
<div class="LV-0"><label>Заказчик и плательщик</label><div>Другой</div></div>
<div class="LV-0"><label> Начальная
 цена </label><div>1 000,50</div></div><a href="https://x/FileStorage/Download?id=1">ТЗ.docx</a><a href="/other">x</a>"""
NOTICE = """<section class="blockInfo__section a"><span class="section__title"> Размер обеспечения
 исполнения контракта </span><span class="section__info">5 %</span></section>
<section class="blockInfo__section"><span class="section__title">Регион</span><span class="section__info">Москва</span></section>
<section class="other"><span class="section__title">Регион</span><span class="section__info">нет</span></section>
<table class="table mb-0"><tr><th>№</th><th>Код позиции</th></tr><tbody><tr><td>1<td>62.01.11<td>3<td>четыре</tr><tr><td>2</td><td>63.11</td><td>6</td><td>8</td></tr></tbody></table>
<table><tr><th>Цена</th></tr><tbody><tr><td>9</td><td>10</td></tr></tbody></table>"""


def texts(html, selector, scope=0):
    page = Page(html)
    return [page.inner_text(i) for i in select(page, compile_selector(selector), scope)]


SECTION = "xpath=//section[contains(@class,'blockInfo__section')][.//span[contains(@class,'section__title') and normalize-space(.)='{}']]//span[contains(@class,'section__info')]"


@pytest.mark.parametrize(
    ("html", "selector", "wanted"),
    [
        (CARDS, "div.List-sc-1 > div:has(div.Main-sc-2) a.Num", ["№ 1", "№ 2"]),
        (CARDS, "a[href*='/need/']:not([href$='2'])", ["№ 1"]),
        (CARDS, ".Main-sc-2 + span.E", ["a"]),
        (CARDS, ".Main-sc-2 ~ .E", ["a", "открыт", "Стулья"]),
        (CARDS, "span:nth-of-type(2), span.E:last-child", ["открыт", "Стулья"]),
        (CARDS, "div:has(> a.Num) ~ span:nth-child(2n+1)", ["открыт"]),
        (DETAIL, "div.LV-0:has(label:text-is('Заказчик')) > div", ["ГБУ Ромашка"]),
        (DETAIL, "div.LV-0:has(label:text-is('Заказчик')) a", ["Ромашка"]),
        (DETAIL, "div.LV-0:has(label:text-is('Начальная цена')) > div", ["1 000,50"]),
        (DETAIL, "label:has-text('ЗАКАЗЧИК')", ["Заказчик", "Заказчик и плательщик"]),
        (DETAIL, ":text('ромашка')", ["Ромашка"]),
        (DETAIL, "a[href*='FileStorage/Download']", ["ТЗ.docx"]),
        (DETAIL, "css=a[href='/OTHER' i]", ["x"]),
        (NOTICE, "table.table.mb-0 td:nth-child(4)", ["четыре", "8"]),
        (NOTICE, "tbody > tr:first-child > td:nth-last-child(2)", ["3", "9"]),
        (NOTICE, "xpath=//table[.//th[contains(.,'Код позиции')]]//tbody/tr/td[2]", ["62.01.11", "63.11"]),
        (NOTICE, SECTION.format("Размер обеспечения исполнения контракта"), ["5 %"]),
        (NOTICE, SECTION.format("Регион"), ["Москва"]),
        (NOTICE, "//table[2]//td[last()] | //table[1]//tr[2]/td[position()=1]", ["2", "10"]),
        (NOTICE, "//span[starts-with(@class, 'section__t') and not(contains(., 'контракта'))]", ["Регион", "Регион"]),
        (NOTICE, "xpath=//section[@class='other' or span[.='Размер']]/span[text()='нет']", ["нет"]),
    ],
)
def test_forms(html, selector, wanted):
    assert texts(html, selector) == wanted


def test_scopes():
    page = Page(CARDS)
    first, second = select(page, compile_selector("div.List-sc-1 > div:has(div.Main-sc-2)"))
    assert [page.inner_text(i) for i in select(page, compile_selector("span.E"), first)] == ["a", "открыт", "Стулья"]
    assert [page.attrs[i]["href"] for i in select(page, compile_selector("div.List-sc-1 a"), second)] == ["/need/2"]  # an ancestor outside
    assert [page.attrs[i]["href"] for i in select(page, compile_selector("xpath=//a"), second)] == ["/need/2"]
    assert select(page, compile_selector("xpath=//div[contains(@class,'List')]//a"), second) == []


@pytest.mark.parametrize("selector", ["", "a >", "> a", "a,", "a:hover", "a:nth-child(x)", "a:has(", "a[", "a b:text-is", "div::before", "xpath=//a[", "//a/@href", "//a/..", "(//a)[1]", "//a[count(b)=1]", "//a['x']", "xpath=//a[.=b]"])
def test_unknown_forms_raise(spark, selector):
    with pytest.raises(ValueError):
        compile_selector(selector)
    if selector:
        with pytest.raises(ValueError):
            extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), [Variable("x", selector)])


def random_page(rng):
    def node(depth):
        inside = "".join(rng.choice(["x", "y z", " ", "  x\n"]) if rng.random() < 0.5 or depth > 4 else node(depth + 1) for _ in range(rng.randint(0, 4)))
        tag = rng.choice(["div", "span", "b"])
        return f'<{tag} class="{rng.choice(["a", "b", "a b", ""])}" id="{rng.choice("pq")}">{inside}</{tag}>'

    return "<div>" + "".join(node(0) for _ in range(4)) + "</div>"


def brute(root, selector):
    """Each element by itself against a selector given as nested tuples of the same meaning."""
    parents = {c: p for p in root.iter() for c in p}
    flat = lambda e: " ".join("".join(e.itertext()).split())

    def fits(e, c):
        kind, v = c[0], c[1]
        siblings = list(parents[e]) if e in parents else [e]
        if kind == "tag":
            return e.tag == v
        if kind == "class":
            return v in e.get("class", "").split()
        if kind == "nth":
            return siblings.index(e) + 1 == v
        if kind == "text":
            return flat(e) == v
        if kind == "contains":
            return v in "".join(e.itertext())
        if kind == "has":
            return any(chain(d, v[0], v[1], e) for d in e.iter() if d is not e)
        raise AssertionError(kind)

    def chain(e, steps, relations, scope=None):
        if not all(fits(e, c) for c in steps[-1]):
            return False
        up, relation = parents.get(e), relations[-1]
        if len(steps) == 1:
            return scope is None or (up is scope if relation == ">" else True)
        if relation == ">":
            return up is not None and up is not scope and chain(up, steps[:-1], relations[:-1], scope)
        while up is not None and up is not scope:
            if chain(up, steps[:-1], relations[:-1], scope):
                return True
            up = parents.get(up)
        return False

    order = {e: i for i, e in enumerate(root.iter(), 1)}
    return [order[e] for e in root.iter() if chain(e, *selector)]


@pytest.mark.parametrize(
    ("selector", "same"),
    [
        ("div.a span", ([[("tag", "div"), ("class", "a")], [("tag", "span")]], [" ", " "])),
        ("div > .b > span", ([[("tag", "div")], [("class", "b")], [("tag", "span")]], [" ", ">", ">"])),
        (".a div b:nth-child(2)", ([[("class", "a")], [("tag", "div")], [("tag", "b"), ("nth", 2)]], [" ", " ", " "])),
        ("div:has(> span b)", ([[("tag", "div"), ("has", ([[("tag", "span")], [("tag", "b")]], [">", " "]))]], [" "])),
        ("span:has(.a > b) b", ([[("tag", "span"), ("has", ([[("class", "a")], [("tag", "b")]], [" ", ">"]))], [("tag", "b")]], [" ", " "])),
        ("xpath=//div[normalize-space(.)='x y z']//span", ([[("tag", "div"), ("text", "x y z")], [("tag", "span")]], [" ", " "])),
        ("xpath=//span[contains(., 'xy')]", ([[("tag", "span"), ("contains", "xy")]], [" "])),
        ("xpath=//div[.//b[contains(., 'x x')]]/span", ([[("tag", "div"), ("has", ([[("tag", "b"), ("contains", "x x")]], [" "]))], [("tag", "span")]], [" ", ">"])),
    ],
)
def test_equals_element_by_element(selector, same):
    rng, found = random.Random(7), 0
    for _ in range(150):
        html = random_page(rng)
        own = select(Page(html), compile_selector(selector))
        assert own == brute(ET.fromstring(html), same), html
        found += len(own)
    assert found > 5


@pytest.mark.parametrize("html", ["<noscript>" * 20_000, "<svg>x" * 20_000, "<div><p>" * 20_000 + "</b>" * 20_000, "</td>" * 40_000, "<table><tr><td>x" * 10_000, "<div><span>x</span>" * 20_000, "<!--" * 20_000, "<a href='" * 20_000, "<a href=\"x" * 20_000 + "\"", "<a b=c " * 20_000, "< " * 40_000, "<title>" * 20_000])
def test_time_grows_with_the_page(html):
    selectors = [compile_selector(s) for s in ("div > span:nth-child(1)", "div:has(span:text-is('x')) span", "svg:has-text('xx')", "xpath=//td[contains(., 'x')][.//tr]/table", "xpath=//div[normalize-space(.)='x']", ":text('x')")]
    began = time.perf_counter()
    page = Page(html)
    for s in selectors:
        select(page, s)
    assert time.perf_counter() - began < 3


def test_extract_detail(spark):
    rows = spark.createDataFrame([(1, "u", DETAIL, "extra"), (2, "v", None, None), (3, "w", NOTICE, "")], "page_id long, url string, html string, matches string")
    variables = [
        Variable("customer", "div.LV-0:has(label:text-is('Заказчик')) > div", handler="strip", default=""),
        Variable("nmck", "div.LV-0:has(label:text-is('Начальная цена')) > div", handler="money"),
        Variable("code", "xpath=//table[.//th[contains(.,'Код позиции')]]//tbody/tr/td[2]", handler="regex", handler_arg=r"(\d{2}(?:\.\d{1,4})*)"),
        Variable("region", SECTION.format("Регион"), handler="strip"),
    ]
    out = {r["page_id"]: tuple(r)[3:] for r in extract.extract(rows, variables).collect()}
    assert out == {1: ("ГБУ Ромашка", 1000.5, None, None), 2: ("", None, None, None), 3: ("", None, "62.01.11", "Москва")}
