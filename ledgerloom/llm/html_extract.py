"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

A page is cut into tags and text and made a tree of block nodes, whose leaves are the runs of text
between them; inline markup belongs to the run that it stands in. Trees score each node from its
subtree's density of text, links and marks, the tokens of its tag, class, id and role, its depth, and the
length and density of its parent and siblings. Decoding
then labels the whole tree at once: from the root down a path enters the main text at most
once and is cut out of it at most once, never to enter again, so the choices of an ancestor
and of a descendant cannot contradict each other. Text in nodes that are in is joined in page order.

The trees are fitted on the driver to pages that this module makes up, with menus, headers,
footers, sidebars, notices, adverts, forms and comments around and inside an article, which stands in a
marked or unmarked element, in a table's cell, in pre, or bare in the body.

Defined results: a null or empty html has text "" and n_chars 0; broken markup is read as
far as it goes, a head without an end tag ends at text or at the first tag that cannot stand in
it, any other unseen element without one where a block begins; a page of any length is read whole; repeated rows get equal rows; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as html_module
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE = frozenset("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text: what stands in them is code, or is shown elsewhere than in the page.
UNSEEN = frozenset("script style noscript template head title iframe object svg select textarea button".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
#: What a head can hold; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta title script style noscript template".split())
#: Start tags that end an open unseen element whose own end tag is left out.
ENDS_UNSEEN = ENDS_P | frozenset("body caption center dd details dialog dt figcaption hgroup li search summary tbody td tfoot th thead tr".split())
#: An open element of these ends where a sibling begins.
ENDS_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: A tag ends at ">", or where the next one begins if that comes first. No part of a page is read twice.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*+)((?:\"[^\"]*\"|'[^']*'|[^<>\"']++)*+)(?:>|(?=<))", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[A-Za-z]+")
#: Word stems that class names use, by what they tell.
MAIN_TOKENS = ("article", "articlebody", "content", "main", "post", "story", "entry", "body", "text", "blog", "prose")
SIDE_TOKENS = ("nav", "menu", "header", "footer", "sidebar", "side", "aside", "breadcrumb", "toolbar", "banner", "masthead", "widget", "related", "share", "social", "tags", "meta", "pagination", "pager", "copyright", "site")
NOTICE_TOKENS = ("ad", "ads", "advert", "advertisement", "sponsor", "promo", "cookie", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "alert", "gdpr", "form", "search", "login", "signup")
REMARK_TOKENS = ("comment", "comments", "reply", "replies", "discussion", "respond", "disqus", "review", "reviews")
TAG_GROUPS = (("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "dialog"), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("div",), ("section",), ("table", "tbody", "tr", "td", "th"), ("blockquote", "pre", "figure"), ("body", "html", "#root"), ("#text",))
_GROUP = {tag: k for k, tags in enumerate(TAG_GROUPS) for tag in tags}
#: The states of a node, and what it costs to enter the main text and to cut a part out of it, in log-odds.
ABOVE, IN, CUT = range(3)
ENTER, LEAVE = 1.0, 1.5


class Page(NamedTuple):
    tags: list[str]
    names: list[frozenset[str]]
    parents: list[int]
    runs: list[tuple[int, str]]  # (leaf, decoded text of a block), in page order
    linked: list[int]  # characters of links in each run
    inner: list[int]  # inline marks directly in each node


def _unclosed(tokens: list[re.Match]) -> set[int]:
    """Where the unseen elements begin that have no end tag of their own; an end tag is that of the last open one."""
    open_: dict[str, list[int]] = {}
    for m in tokens:
        tag = (m.group(3) or "").lower()
        if tag not in UNSEEN:
            continue
        if not m.group(2):
            if not m.group(4).endswith("/"):
                open_.setdefault(tag, []).append(m.start())
        elif open_.get(tag):
            open_[tag].pop()
    return {at for places in open_.values() for at in places}


def parse(html: str | None) -> Page:
    tags, names, parents, linked, inner = ["#root"], [frozenset()], [-1], [0], [0]
    runs: list[tuple[int, str]] = []
    stack, hidden, links, pending, in_links, at, html = [0], 0, 0, [], 0, 0, html or ""
    open_ = Counter(["#root"])
    tokens = list(TOKEN.finditer(html))
    unclosed, loose = _unclosed(tokens), set()

    def flush() -> None:
        """What was said since the last block began or ended is a leaf of its own."""
        nonlocal in_links
        if pending:
            text = " ".join(html_module.unescape("".join(pending)).split())
            if text:
                runs.append((len(tags), text))
                tags.append("#text"), names.append(frozenset()), parents.append(stack[-1]), linked.append(in_links), inner.append(0)
            pending.clear()
            in_links = 0

    def pop() -> None:
        nonlocal hidden
        flush()
        tag = tags[stack.pop()]
        open_[tag] -= 1
        hidden -= tag in UNSEEN

    def say(text: str) -> None:
        nonlocal in_links
        if tags[stack[-1]] == "head" and text and not text.isspace():
            pop()
        if not hidden and text:
            pending.append(text)
            if links:
                in_links += len(text)

    for m in tokens:
        say(html[at : m.start()])
        at, tag = m.end(), (m.group(3) or "").lower()
        if not tag:
            continue
        if m.group(2):
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and tag not in VOID and open_[tag]:
                while tags[stack[-1]] != tag:
                    pop()
                pop()
                links = 0
            continue
        while hidden and loose and any(k in loose and (tag in ENDS_UNSEEN or tag == tags[k]) for k in stack):
            pop()
        if tags[stack[-1]] == "head" and tag not in IN_HEAD:
            pop()
        if tag in INLINE:
            inner[stack[-1]] += 1
            if tag == "br":
                say("\n")
            elif tag == "a":
                links = 1
            continue
        flush()
        if tag in VOID:
            continue
        links = 0
        while tag in ENDS_P and open_["p"]:
            pop()
        if tag in ENDS_SELF and any(open_[t] for t in ENDS_SELF[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] in SCOPE[tag]:
                    break
                if tags[stack[depth]] in ENDS_SELF[tag]:
                    while len(stack) > depth:
                        pop()
                    break
        parents.append(stack[-1])
        tags.append(tag)
        names.append(frozenset(p.lower() for x in NAMED.findall(m.group(4)) for p in PARTS.findall("".join(x))) if m.group(4) else frozenset())
        linked.append(0), inner.append(0)
        stack.append(len(tags) - 1)
        open_[tag] += 1
        hidden += tag in UNSEEN
        if m.start() in unclosed:
            loose.add(stack[-1])
        if m.group(4).endswith("/") and tag in UNSEEN:
            pop()
    say(re.sub(r"<[a-zA-Z/!][^>]*\Z", "", html[at:]))
    flush()
    return Page(tags, names, parents, runs, linked, inner)


def features(page: Page) -> np.ndarray:
    """(nodes, features): of the node, its subtree, its ancestors' names and its siblings."""
    n = len(page.tags)
    chars, words, marks, links, blocks, nodes, inner = (np.zeros(n) for _ in range(7))
    for node, text in page.runs:
        chars[node] += len(text)
        words[node] += text.count(" ") + 1
        marks[node] += text.count(".") + text.count(",")
        blocks[node] += 1
    links += page.linked
    inner += page.inner
    nodes += 1
    paragraphs = np.array([t == "p" for t in page.tags], dtype=float)
    depth, children = np.zeros(n), np.zeros(n)
    for node in range(n - 1, 0, -1):
        up = page.parents[node]
        children[up] += 1
        for of in (chars, words, marks, links, blocks, nodes, inner, paragraphs):
            of[up] += of[node]
    place, seen = np.zeros(n), np.zeros(n)
    groups, hints = np.zeros((n, len(TAG_GROUPS) + 1)), np.zeros((n, 4))
    for node in range(n):
        groups[node, _GROUP.get(page.tags[node], len(TAG_GROUPS))] = 1
        if page.names[node]:
            hints[node] = [any(t in page.names[node] for t in tokens) for tokens in (MAIN_TOKENS, SIDE_TOKENS, NOTICE_TOKENS, REMARK_TOKENS)]
        if node:
            up = page.parents[node]
            depth[node], place[node] = depth[up] + 1, seen[up]
            seen[up] += 1
    above, held = np.zeros((n, 4)), np.zeros((n, 6))
    for node in range(1, n):
        up = page.parents[node]
        above[node] = np.maximum(above[up], hints[up])
        held[node] = np.maximum(held[up], groups[up, :6])
    parent = np.maximum(np.array(page.parents), 0)
    # of the siblings before and after, and of all: how long, how linked, how much like sentences
    before, after, last = np.zeros(n, dtype=int), np.zeros(n, dtype=int), np.zeros(n, dtype=int)
    for node in range(1, n):
        up = page.parents[node]
        before[node], after[last[up]], last[up] = last[up], node, node
    after[0] = before[0] = 0
    beside = []
    for other in (before, after):
        there = other > 0
        beside += [np.where(there, np.log1p(chars[other]), -1), np.where(there, links[other] / np.maximum(chars[other], 1), -1), np.where(there, marks[other] / np.maximum(words[other], 1), -1)]
    beside += [links[parent] / np.maximum(chars[parent], 1), marks[parent] / np.maximum(words[parent], 1), np.log1p(chars[parent] / np.maximum(children[parent], 1)), paragraphs[parent] / np.maximum(children[parent], 1)]
    whole, some = max(chars[0], 1.0), np.maximum(chars, 1.0)
    own = [np.log1p(chars), chars / whole, chars / np.maximum(chars[parent], 1.0), links / some, nodes * 100 / some, inner * 100 / some, marks / np.maximum(words, 1.0), chars / np.maximum(blocks, 1.0), paragraphs, depth, children, children[parent], place / np.maximum(children[parent], 1.0)]
    return np.column_stack([*own, *beside, groups, hints, above, held])


class Trees(NamedTuple):
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    limit: np.ndarray
    leaf: np.ndarray  # (trees, leaves)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 90, depth: int = 4, rate: float = 0.3, bins: int = 16) -> Trees:
    """Newton boosting of the logistic loss on histograms, trees of full depth."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    features, offset, rows = x.shape[1], np.arange(x.shape[1]) * bins, np.arange(len(y))
    width, there = features * bins, np.arange(bins) < np.array([len(c) for c in cuts])[:, None]
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    score, feature, limit, leaf = np.full(len(y), base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        at, f, v = np.zeros(len(y), dtype=int), np.zeros(2**depth - 1, dtype=int), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            slot = ((at - first)[:, None] * width + offset + binned).ravel()
            # of each node, feature and bin: what lies at or under its upper cut
            gs, hs = (np.bincount(slot, weights=np.repeat(w, features), minlength=many * width).reshape(many, features, bins).cumsum(axis=2) for w in (g, h))
            gm, hm = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + 1) + (gm - gs) ** 2 / (hm - hs + 1) - gm**2 / (hm + 1)
            gain[:, ~there] = 0
            gain = gain.reshape(many, -1)
            best = gain.argmax(axis=1)
            for k in np.flatnonzero(gain[np.arange(many), best] > 1e-6):
                f[first + k], v[first + k] = best[k] // bins, cuts[best[k] // bins][best[k] % bins]
            at = 2 * at + 1 + (x[rows, f[at]] > v[at])
        leaves = at - (2**depth - 1)
        value = -rate * np.bincount(leaves, weights=g, minlength=2**depth) / (np.bincount(leaves, weights=h, minlength=2**depth) + 1)
        score += value[leaves]
        feature.append(f), limit.append(v), leaf.append(value)
    return Trees(base, np.array(feature), np.array(limit), np.array(leaf))


def score(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Log-odds that a node is of the main text."""
    total, rows = np.full(len(x), trees.base), np.arange(len(x))
    for f, v, leaf in zip(trees.feature, trees.limit, trees.leaf, strict=True):
        at = np.zeros(len(x), dtype=int)
        while at[0] < len(f):
            at = 2 * at + 1 + (x[rows, f[at]] > v[at])
        total += leaf[at - len(f)]
    return total


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Which nodes are of the main text, by the states of all nodes with the best sum of odds, less the prices.

    A node is above the main text (its own text is not of it), in it, or cut. Below a node in the main text all is in
    or cut; below a cut one all is cut. So nothing is kept under what was thrown away.
    """
    n = len(page.tags)
    above, inside, cut = np.zeros(n), odds / 2, -odds / 2
    for node in range(n - 1, 0, -1):
        up = page.parents[node]
        above[up] += max(above[node], inside[node] - ENTER, cut[node])
        inside[up] += max(inside[node], cut[node] - LEAVE)
        cut[up] += cut[node]
    states = [CUT] * n
    for node in range(n):
        before = states[page.parents[node]] if node else ABOVE
        if before == ABOVE:
            enters = inside[node] - ENTER > max(above[node], cut[node])
            states[node] = IN if enters else ABOVE if above[node] > cut[node] else CUT
        elif before == IN:
            states[node] = IN if inside[node] > cut[node] - LEAVE else CUT
    return [state == IN for state in states]


def extract(trees: Trees, pages: list[str | None]) -> list[str]:
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    table = [features(p) for p in parsed]
    odds = np.clip(score(trees, np.concatenate(table)), -6, 6)
    out, at = [], 0
    for page, rows in zip(parsed, table, strict=True):
        kept = decode(page, odds[at : at + len(rows)].copy())
        at += len(rows)
        out.append(" ".join(text for node, text in page.runs if kept[node]))
    return out


def made_up(rng: random.Random) -> tuple[str, set[str]]:
    """A page and the words of its article, each word in one place only."""
    count = iter(range(10**6))
    word = lambda tag: f"{tag}{next(count)}{rng.choice(['n', 'ing', 'th', 'era', 'ment', 'solu'])}"
    say = lambda tag, low, high: " ".join(word(tag) + rng.choice(["", "", "", "", ",", "."]) for _ in range(rng.randint(low, high))) + "."
    link = lambda: f'<a href="/{next(count)}">{say("x", 1, 3)[:-1]}</a>'
    menu = lambda: "<ul>" + "".join(f"<li>{link()}{rng.choice(['</li>', '</li>', ''])}" for _ in range(rng.randint(2, 12))) + "</ul>"
    named = lambda *tokens: rng.choice([f' class="{(t := rng.choice(tokens))}"', f' id="{t}"', f' class="{t} box-{rng.randint(1, 9)}"', f' class="site-{t}"'])
    pick = lambda *options: rng.choice(options)
    advert = lambda: pick(f"<div{named('ad', 'ads', 'advert', 'sponsor', 'promo')}>{say('x', 2, 30)}</div>", f"<aside{named('ad', 'promo', 'sponsor')}><p>{say('x', 4, 40)}</p></aside>")
    notice = lambda: f"<div{named('cookie', 'notice', 'consent', 'popup', 'newsletter', 'alert')}><p>{say('x', 5, 40)}</p>{pick('', '<button>ok</button>')}</div>"
    form = lambda: f"<form action='/s'>{pick('<label>' + say('x', 1, 4) + '</label>', '<p>' + say('x', 3, 15) + '</p>')}<input name=q></form>"
    nav = lambda: pick(f"<nav>{menu()}</nav>", f"<div{named('nav', 'menu', 'breadcrumb')}>{menu()}</div>", f"<nav{named('menu')}>{link()} {link()} {link()}</nav>")
    header = lambda: pick("", f"<header><h2>{say('x', 1, 5)}</h2>{pick('', nav())}</header>", f"<div{named('header', 'banner', 'masthead')}><p>{say('x', 1, 12)}</p></div>", f"<header>{say('x', 1, 8)}</header>")
    footer = lambda: pick(f"<footer>&copy; {say('x', 2, 30)}</footer>", f"<footer><p>{say('x', 2, 30)}</p>{menu()}</footer>", f"<div{named('footer', 'copyright')}>&copy; {say('x', 3, 20)}</div>")
    side = lambda: pick(f"<aside><h3>{say('x', 1, 3)}</h3>{pick(menu(), '<p>' + say('x', 5, 50) + '</p>')}</aside>", f"<div{named('sidebar', 'widget', 'related')}><h3>{say('x', 1, 3)}</h3>{pick(menu(), '<p>' + say('x', 5, 50) + '</p>')}</div>")
    remark = lambda: pick(f"<div{named('comment', 'reply')}><p>{say('x', 3, 60)}</p></div>", f"<li><p>{say('x', 3, 60)}</p></li>", f"<p>{say('x', 3, 60)}</p>")
    remarks = lambda: f"<{(t := pick('section', 'div', 'ol'))}{named('comments', 'discussion', 'replies', 'comment')}>{pick('', '<h3>' + say('x', 1, 3) + '</h3>')}{''.join(remark() for _ in range(rng.randint(1, 6)))}</{t}>"
    block = lambda: pick(*(5 * [f"<p>{say('m', 2, 120)}{pick('</p>', '</p>', '')}"]), f"<p><b>{say('m', 2, 15)}<br><p>", f"<h{(k := rng.randint(2, 4))}>{say('m', 1, 9)}</h{k}>", f"<ul><li>{say('m', 1, 20)}</li><li>{say('m', 1, 20)}</li></ul>", f"<blockquote>{say('m', 4, 40)}</blockquote>", f"<p>{say('m', 3, 30)} <a href='/q'>{say('m', 1, 3)}</a> {say('m', 3, 30)}</p>", f"<table><tr><td>{say('m', 1, 5)}</td><td>{say('m', 1, 5)}</td></tr></table>", f"<div>{say('m', 5, 60)}</div>")
    plain = lambda: pick(f"<p>{say('m', 8, 120)}</p>", f"<p>{say('m', 8, 120)}", f"{say('m', 15, 100)}<br><br>", f"<div>{say('m', 10, 100)}</div>", f"<h{(k := rng.randint(2, 4))}>{say('m', 1, 9)}</h{k}>", f"<ul><li>{say('m', 3, 20)}</li><li>{say('m', 3, 20)}</li></ul>")
    strange = lambda rate: pick(advert(), form(), notice()) if rng.random() < rate else ""
    body = pick(f"<h1>{say('m', 1, 12)}</h1>", f"<header><h1>{say('m', 1, 12)}</h1></header>", "") + "".join(block() + strange(0.06) for _ in range(rng.randint(1, 14))) + (remarks() if rng.random() < 0.15 else "")
    unmarked = rng.random() < 0.5
    if unmarked:
        body = pick(f"<h1>{say('m', 1, 12)}</h1>", f"<h2>{say('m', 1, 12)}</h2>", "") + pick(
            *(2 * ["".join(plain() + strange(0.05) for _ in range(rng.randint(1, 14)))]), "".join(f"<p>{say('m', 8, 120)}</p>" for _ in range(rng.randint(1, 12))), f"<pre>{say('m', 20, 300)}</pre>", say("m", 30, 400), "".join(f"{say('m', 10, 100)}<br><br>" for _ in range(rng.randint(1, 9)))
        ) + (remarks() if rng.random() < 0.15 else "")
        where, outer = rng.randint(0, 5), ""
        if where == 4:
            cell = pick("", f"<td>{menu()}</td>", f"<td>{say('x', 1, 8)}</td>")
            outer = f"<table><tr>{cell}<td>{body}</td>{pick('', f'<td>{menu()}</td>')}</tr></table>"
        body = (body, body, f"<div>{body}</div>", f"<div><div>{body}</div></div>", outer, f"<div class='{pick('wrap', 'page', 'container', 'col', 'row', 'inner')}'>{body}</div>")[where]
    else:
        body = pick(*(4 * [f"<article>{body}</article>"]), f"<main>{body}</main>", f"<main><article>{body}</article></main>", f"<article{named('post', 'story', 'entry')}>{body}</article>", f"<div{named('content', 'article', 'post', 'main', 'entry', 'story')}>{body}</div>", f"<section{named('content', 'article', 'main')}><div>{body}</div></section>")
    if rng.random() < 0.2 and not unmarked:
        body = f"<div{named('wrap', 'page', 'container', 'layout')}>{pick('', side())}{body}{pick('', side(), remarks())}</div>"
    around = [x for x in (nav() if rng.random() < 0.8 else "", header(), notice() if rng.random() < 0.25 else "", advert() if rng.random() < 0.4 else "", form() if rng.random() < 0.2 else "", side() if rng.random() < 0.2 else "") if x]
    rng.shuffle(around)
    after = [x for x in (remarks() if rng.random() < 0.4 else "", side() if rng.random() < 0.25 else "", advert() if rng.random() < 0.25 else "", notice() if rng.random() < 0.15 else "", footer() if rng.random() < 0.85 else "") if x]
    page = f"<!DOCTYPE html><html><head><title>{say('x', 1, 9)}</title><script>var x='</p>';</script></head><body>{''.join(around)}{body}{''.join(after)}</body></html>"
    return page, set(re.findall(r"\bm\d+[a-z]+", body))


@lru_cache(maxsize=1)
def trained(pages: int = 900, seed: int = 5) -> Trees:
    """Fitted to made-up pages: a node is of the main text if most of its subtree's characters are."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page = parse(made_up(rng)[0])
        good, every = np.zeros(len(page.tags)), np.zeros(len(page.tags))
        for node, text in page.runs:
            every[node] += len(text)
            good[node] += len(text) * bool(re.match(r"m\d", text))
        for node in range(len(page.tags) - 1, 0, -1):
            every[page.parents[node]] += every[node]
            good[page.parents[node]] += good[node]
        # roots of mixed content teach nothing; nodes without text do not matter
        telling = (every > 0) & ((good <= 0.1 * every) | (good >= 0.9 * every))
        xs.append(features(page)[telling])
        ys.append((good >= 0.9 * every)[telling])
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                texts = extract(shared.value, list(part["html"]))
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "url": part["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]}).astype({"page_id": "Int64"})

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
