"""Pages of other kinds, long labelled texts, and columns whose names clash."""

import random

from ledgerloom.llm import exact_dedup, html_extract, language_id, sharding

A = "The council met on Tuesday evening to discuss the new bridge, which has been delayed for three years. Residents said they were tired of waiting."
B = "Engineers presented a revised plan, with lower costs and a shorter span, and answered questions for more than two hours."
C = "A vote is expected next month. If it passes, work could begin in spring."
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
FOOT = "<footer>Copyright 2024 Example Media</footer>"
PARTS = f"<h1>Bridge plan</h1><p>{A}</p><p>{B}</p><p>{C}</p>"
WANT = f"Bridge plan {A} {B} {C}"
#: Pages whose main text is WANT.
PAGES = [
    f"{NAV}{PARTS}{FOOT}", f"{NAV}<div>{PARTS}</div>{FOOT}", f"{NAV}<div class='wrap'>{PARTS}</div>{FOOT}", f"{NAV}<div><div><div><h1>Bridge plan</h1><p>{A}</p><p>{B}</p></div><p>{C}</p></div></div>{FOOT}",
    f"<table><tr><td><ul><li><a href=/>Home</a></li><li><a href=/b>Other</a></li></ul></td><td>{PARTS}</td></tr></table>", f"{NAV}<pre>Bridge plan\n{A}\n{B}\n{C}</pre>{FOOT}",
    f"{NAV}Bridge plan<br><br>{A}<br><br>{B}<br><br>{C}{FOOT}", f"{NAV}<article>{PARTS}</article>{FOOT}", f"{NAV}<article>{PARTS}<section class='comments'><h3>Comments</h3><p>nice post indeed</p><p>I agree with that</p></section></article>{FOOT}",
    f"{NAV}<article>{PARTS}<div id='comments'><p>nice post indeed</p></div></article>{FOOT}", f"{NAV}<main>{PARTS}<form><input></form></main><aside><p>Read also this</p></aside>{FOOT}", PARTS,
    f"<div id=top><a href=/>Home</a> <a href=/n>News</a></div><div>{PARTS}</div><div class=footer>Copyright 2024</div>", f"{NAV}<section><h1>Bridge plan</h1><div>{A}</div><div>{B}</div><div>{C}</div></section>{FOOT}",
    f"{NAV}<div class=cookie><p>We use cookies on this site.</p></div>{PARTS}{FOOT}", f"{NAV}<center>{PARTS}</center>{FOOT}",
]


def share(got, want):
    got, want = set(got.split()), set(want.split())
    return len(got & want) / len(want), len(got & want) / max(len(got), 1)


def test_articles_without_marks_and_with_comments_inside():
    found = [share(t, WANT) for t in html_extract.extract(html_extract.trained(), [f"<html><body>{p}</body></html>" for p in PAGES])]
    assert [r for r, _ in found] == [1.0] * len(PAGES)
    assert [p for _, p in found] == [1.0] * len(PAGES)


def other_pages(seed, count):
    """Pages of another generator than the one that the trees are fitted to: layouts, not parts, are drawn."""
    draw = random.Random(seed)
    vocabulary = {kind: [f"{kind}{''.join(draw.choices('aeioulnrst', k=draw.randrange(2, 9)))}" for _ in range(400)] for kind in "mx"}
    sentence = lambda kind, n: " ".join(draw.choices(vocabulary[kind], k=n)).capitalize().replace(" ", ", ", draw.randrange(2)) + "."
    prose = lambda: " ".join(sentence("m", draw.randrange(8, 22)) for _ in range(draw.randrange(1, 6)))
    for _ in range(count):
        paragraphs = [prose() for _ in range(draw.randrange(2, 9))]
        links = "".join(f"<li><a href='/{i}'>{sentence('x', 2)[:-1]}</a>" for i in range(draw.randrange(3, 10)))
        style = draw.choice(("<p>{}</p>", "<div>{}</div>", "{}<br><br>", "<p>{}"))
        story = f"<h1>{sentence('m', 5)}</h1>" + "".join(style.format(p) for p in paragraphs)
        remarks = f"<div class='comment-list'><p>{sentence('x', 9)}</p><p>{sentence('x', 5)}</p></div>"
        layout = draw.randrange(5)
        if layout == 0:
            body = f"<div id='menu'><ul>{links}</ul></div><div id='page'>{story}</div><div id='footer'>{sentence('x', 8)}</div>"
        elif layout == 1:
            body = f"<header><ul>{links}</ul></header>{story}<footer><p>{sentence('x', 12)}</p></footer>"
        elif layout == 2:
            body = f"<table><tr><td><ul>{links}</ul></td><td>{story}</td></tr></table><p class='copyright'>{sentence('x', 6)}</p>"
        elif layout == 3:
            body = f"<nav><ul>{links}</ul></nav><article>{story}{remarks}</article><aside><ul>{links}</ul></aside>"
        else:
            body = f"<nav><ul>{links}</ul></nav><div class='layout'><div>{story}</div><div class='sidebar'><ul>{links}</ul></div></div>"
        yield f"<html><head><title>{sentence('x', 4)}</title></head><body>{body}</body></html>", story


def test_pages_of_another_generator():
    import re

    pages = list(other_pages(4, 200))
    words = lambda text: re.findall(r"[mMxX][aeioulnrst]+", text)
    found = html_extract.extract(html_extract.trained(), [p for p, _ in pages])
    hit = sum(len(set(words(t)) & set(words(s))) for t, (_, s) in zip(found, pages, strict=True))
    assert hit / sum(len(set(words(s))) for _, s in pages) > 0.95
    assert hit / sum(len(set(words(t))) for t in found) > 0.95


def test_languages_of_long_texts_are_learned(spark):
    draw = random.Random(8)
    words = {"aa": ["ka", "lomi", "tesu", "rano"], "bb": ["vex", "qurt", "zib", "wog"]}
    rows = [(i, " . 1 " * 2000 + " ".join(draw.choices(words[lang], k=2500)), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {i: lang for i, _, lang in rows}


def test_names_that_clash(spark):
    names = "_sha string, _nth int, _repeated boolean, _gone_id long, _gone_sha string, id int, sha int, row string, gone_id int, gone_sha int, repeated int, nth int, shard string, shard_slot int, shard_name string, given string"
    rest = ("s", 1, False, 5, "g", 1, 2, "r", 3, 4, 5, 6, "mine", 8, "name", "x")
    docs = spark.createDataFrame([(i, t, *rest) for i, t in enumerate(["a", "A", "b", None, "", "b"])] + [(5, "b", *rest)], f"doc_id long, text string, {names}")
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "A", *rest), (4, "", *rest), (5, "b", *rest)]
    placed = sharding.assign(docs, "shard", ["p", "q"], 101)
    assert placed.count() == 7 and len(set(placed.columns)) == len(docs.columns) + 3
    assert placed.select("given_shard", "given_shard_slot", "given_shard_name").distinct().collect() == [("mine", 8, "name")]


def test_shards_are_written_whole(spark, tmp_path):
    docs = spark.range(2000).withColumnRenamed("id", "doc_id")
    sharding.write_shards(docs, "doc_id", ["p", "q", "r"], str(tmp_path / "out"), 101)
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id", "shard").distinct().count() == 2000
