"""The training-data operators against brute force, on small fixtures with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import re
import struct
import zlib
from itertools import combinations

import public_tokenizers
import pytest
import xxhash
from cubara.llm import tokens, decontaminate, html_text, langid, lines, packing, passages, simhash, simple8b, syncmers, warc
from cubara.llm.shared import connected
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def groups(links, nodes):
    """Smallest reachable node of each."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


# -- connected components


def test_connected(spark):
    import random

    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected(frame(spark, links, "a long, b long")).collect()}
    whole = [(a, b) for a, b in links if a is not None]
    assert got == groups(whole, {n for x in whole for n in x})
    assert connected(frame(spark, [], "a long, b long")).count() == 0


# -- 1


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    prints = [(d, slow_print(t)) for d, t in rows]
    links = [(a, b) for (a, x), (b, y) in combinations(prints, 2) if (x ^ y).bit_count() <= 2 and a is not None and b is not None]
    return {d: (f"{p:016x}", c) for (d, p), c in ((x, groups(links, {d for d, _ in prints if d is not None}).get(x[0])) for x in prints)}


def test_simhash(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(1000, None), (1001, ""), (1002, " \t"), (1003, "One"), (1004, "one"), (1005, "a b c d"), (1004, "one")]
    got = simhash.near_duplicates(frame(spark, rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1)))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got.collect()} == slow_components(rows)
    assert got.count() == len(rows)
    assert simhash.near_duplicates(frame(spark, [], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("heavy", [0, 2, 1000])
def test_simhash_links(spark, heavy):
    """Crowded keys and pairs link the same groups: fingerprints around a few centres, some on chains."""
    import random

    rng = random.Random(3)
    prints = {0}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            prints.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
            if rng.random() < 0.2:
                x ^= rng.getrandbits(64) & rng.getrandbits(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r["a"], r["b"]) for r in simhash.links(frame(spark, [(p,) for p in signed], "fp long"), heavy).collect()}
    near = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert groups(got, signed) == groups(near, signed)


# -- 3


def slow_contamination(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        words, hit, names = cut(t), set(), set()
        for i, it in items:
            item = cut(it)
            n = min(13, len(item))
            for k in range(len(item) - n + 1) if n else ():
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == item[k : k + n]:
                        hit |= set(range(p, p + n))
                        names.add(str(i))
        out.append((d, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 24, 600])
def test_decontamination(spark, docs, block_bytes):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, long), (3, "Short item HERE"), (4, None), (5, "..."), (10, "été über straße"), (6, "a a a a a a a a a a a a a a a")]
    items += [(100 + r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [(r["doc_id"], r["text"]) for r in docs.where("doc_id < 60").select("doc_id", "text").collect()]
    texts += [(1000, long + " x " + long), (1001, "say short item here."), (1002, None), (1003, ""), (1004, "Été, über straße! " + "z " * 80), (1005, " ".join(f"w{i}" for i in range(5, 20))), (1006, "a " * 14), (1007, " ".join(f"w{i}" for i in range(5, 17)))]
    got = decontaminate.contamination(frame(spark, texts, "doc_id long, text string").withColumn("items", F.lit(1)), frame(spark, items, "item_id long, text string"), block_bytes=block_bytes)
    assert sorted((tuple(r)[:5] + (r["contaminated"],) for r in got.collect()), key=str) == slow_contamination(texts, items)
    none = frame(spark, [], "item_id long, text string")
    assert decontaminate.contamination(frame(spark, texts, "doc_id long, text string"), none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(frame(spark, [], "doc_id long, text string"), frame(spark, items, "item_id long, text string"), block_bytes=block_bytes).count() == 0


def test_decontamination_keeps_rows_in_blocks(spark):
    """Null and repeated ids have a row for each of theirs with its own hits, in one block and in several."""
    items = [(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(12)]
    text = {k: t for k, t in items}
    rows = [(None, text[1]), (None, text[2] + " " + text[7]), (None, None), (None, None), (5, text[3]), (5, text[3]), (5, text[4] + " x"), (5, ""), (6, "clean"), (6, "clean")]
    for block_bytes in (1 << 24, 600):
        got = decontaminate.contamination(frame(spark, rows, "doc_id long, text string"), frame(spark, items, "item_id long, text string"), block_bytes=block_bytes)
        assert sorted((tuple(r)[:5] + (r["contaminated"],) for r in got.collect()), key=str) == slow_contamination(rows, items)


# -- 4


def test_html_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=1>Menu</a></li></ul></nav>
    <div class="ad">Buy now</div><article><h1>Title &amp; more</h1><p><b>First  part,<br>goes on.<p>Second\n one &#233;&lt;x.</p><script>var a="</p>";</script>
    <ul><li>Point one, is long.<li>Point two</ul><form><input>Name</form><div class="comments"><p>Nice post, thanks!</p></div></article>
    <aside>Side</aside><footer>&copy; x</footer>"""
    text = "Title & more\nFirst part, goes on.\nSecond one é<x.\nPoint one, is long.\nPoint two"
    plain = page.replace("<article>", "<div>").replace("</article>", "</div>")
    pages = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p"), (5, "u", "no tags at all"), (None, "u", page), (6, "u", plain)]
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(frame(spark, pages, "page_id long, url string, html string").withColumn("text", F.lit(3))).collect()}
    assert {(1, text, len(text)), (2, "", 0), (3, "", 0), (5, "no tags at all", 14), (None, text, len(text))} <= got
    assert html_text.extract(plain).startswith("Title & more\nFirst part, goes on.\nSecond one é<x.")
    for bad in ("Menu", "Buy now", "Nice post", "Side", "©", "Name", "var a"):
        assert bad not in html_text.extract(plain)
    assert html_text.main_text(frame(spark, [], "page_id long, url string, html string")).count() == 0
    deep = "<div>" * 3000 + "<p>" + "word, " * 20000 + "</p>"
    assert len(html_text.extract(deep)) > 100000


def test_html_text_of_marked_pages():
    """The threshold chooses on marked pages, too: cards or comments in <article> don't put out a story in a <div>."""
    story = [f"Paragraph {k} of the story, which goes on for a while, says what it has to say, and ends; then it says more of it." for k in range(6)]
    body = "<div><h1>Story's title</h1>" + "".join(f"<p>{x}</p>" for x in story) + "</div>"
    cards = "<section>" + "".join(f"<article><h3><a href=/{k}>Card {k}</a></h3><p>Read this.</p></article>" for k in range(8)) + "</section>"
    want = "\n".join(["Story's title", *story])
    for page in (body + cards, cards + body, f"<main>{body}{cards}</main>", f"<article>{body}</article>{cards}"):
        assert html_text.extract(f"<html><body>{page}</body></html>") == want
    assert html_text.extract(f"<html><body>{body}</body></html>") == want
    said = "".join(f"<article><p>I like number {k}.</p></article>" for k in range(8))
    assert html_text.extract(f"<html><body><div>{body}</div>{said}</body></html>").startswith(want)
    table = "<article><p>" + story[0] * 3 + "</p><table><tr><td>12<td>13</table><ul><li>one<li>two</ul></article><div><p>Not of it.</p></div>"
    assert html_text.extract(f"<html><body>{table}</body></html>") == "\n".join([story[0] * 3, "12", "13", "one", "two"])


def test_html_text_raw_and_deep():
    """Scripts aren't markup, and blocks of any depth end where they end."""
    text = "It goes on, after all, and on."
    for raw in ("<script>for(i=0;i<n;i++){f(i)}</script>", "<script>s='<!--'</script>", "<STYLE>a<b{}</Style >", "<script>x='<p title=\"'</script\n>", "<title>a<b</title>"):
        assert html_text.extract(f"<div>{raw}<p>{text}</p></div>") == text
    assert html_text.extract(f"<p>{text}</p><script>if(a<b)") == text
    deep = "<div>" * 250 + f"<p>{text}</p><nav>Menu</nav><aside>Side, by side, it is.</aside>" + "</div>" * 250
    assert html_text.extract(f"<div><article>{deep}<p>{text}</p></article></div>") == f"{text}\n{text}"
    assert html_text.extract(f"<div>{deep}<p>{text}</p></div>") == f"{text}\n{text}"
    # Nothing in the article goes for its links or for a word that is a notice only around it, and lists beside paragraphs stay.
    inner = f"<p>{text}</p><p><a href=x>A whole linked paragraph.</a></p><div class='side notes'>Kept, too.</div><ul><li>one<li>two</ul>"
    assert html_text.extract(f"<article>{inner}</article>") == f"{text}\nA whole linked paragraph.\nKept, too.\none\ntwo"
    story = "".join(f"<p>{text} {text} {text}</p>" for _ in range(4))
    assert html_text.extract(f"<div>{story}<ul><li>one<li>two</ul></div><ul><li><a href=x>Menu</a></ul>").endswith(f"{text}\none\ntwo")
    # Malformed pages are read once.
    import time

    began = time.time()
    for bad in ("<a " * 300_000, '<p title="' * 100_000, "<script>" + "</script " * 100_000, "<p title='" * 50_000 + ">x" * 50_000, "<" * 300_000, '<p a="b' * 100_000 + ">"):
        html_text.extract(bad)
    assert time.time() - began < 10
    wide = "<table><tr><td>" * 20000 + f"<p>{text}</p>" + "<p>x</i></b></li></td>" * 20000
    assert text in html_text.extract(wide)


def test_html_text_of_pages(spark):
    """Everything in the article and nothing else, by a plainer reading of these pages."""
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert html_text.extract(r["html"]) == "\n".join(x for x in want if x)


# -- 5


def test_langid(spark, docs):
    got = langid.identify(docs.withColumn("score", F.lit("x"))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    odd = [(1, None, "en", "s", 0), (2, "123 !?", "en", "s", 0), (3, "", None, "s", 0), (None, "the that of", "en", "s", 0), (4, "the of that", "en", "s", 1), (4, "the of that", "en", "s", 1)]
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(frame(spark, odd, DOCS)).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "en")}
    assert langid.identify(frame(spark, [], DOCS)).count() == 0


def _whole_counts(text):
    import numpy as np

    return np.unique(langid.grams(langid._folded(text), 0, len(text)), return_counts=True)


def test_langid_samples_each_label(spark):
    """A rare label is learnt however small its share is, and more labels than fit at once."""
    words = lambda k: " ".join(f"{chr(97 + k)}{chr(97 + (k * j) % 26)}{chr(98 + j % 9)}" for j in range(40))
    rows = [(d, words(1), "big", "s", 1) for d in range(3000)] + [(d, words(k), f"l{k}", "s", 1) for k in range(2, 22) for d in range(5000 + 5 * k, 5005 + 5 * k)]
    model = langid.train(frame(spark, rows, DOCS), sample=10)
    assert len(model.languages) == 21
    got = model.mixtures([words(k).encode() for k in range(2, 22)] * 40)
    assert [g[0] for g in got] == [f"l{k}" for k in range(2, 22)] * 40


def test_langid_mixture(spark, docs):
    model = langid.train(docs.unionByName(frame(spark, [(9, "12 34", "zz", "s", 5)], DOCS)))
    assert "zz" not in model.languages
    text = ("the tion ing " * 120_000).encode()  # over a slice: the n-grams are those of the whole
    assert len(text) > langid.SLICE and all((a == b).all() for a, b in zip(langid.counts(text), _whole_counts(text)))
    part = {r["lang"]: r["text"] for r in docs.where("lang in ('en', 'de') and n_chars > 2000").collect()}
    half = lambda t: " ".join(t.split()[:150])
    (_, score, mix), = model.mixtures([(half(part["en"]) + " " + half(part["de"])).encode()])
    assert set(mix) == {"en", "de"} and 0.35 < mix["en"] < 0.65 and score < 0.66
    (name, score, mix), = model.mixtures([half(part["de"]).encode()])
    assert name == "de" and score == 1 and set(mix) == {"de"}


# -- 6


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 200
    pages = [(3, "u3", big), (1, "u1", big), (2, "u2", "small"), (4, None, "small"), (5, "u5", None), (6, "u6", ""), (7, "u\r\n7", "é" * 60), (None, "n", big), (1, "u1", big)]
    got = warc.archive(frame(spark, pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)), str(tmp_path / "a"))
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        refers = 1 if len(data) >= 100 and h == big and i not in (1, None) else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted(want, key=str)
    assert warc.archive(frame(spark, [], "page_id long, url string, html string"), str(tmp_path / "b")).count() == 0


def test_warc_bundle():
    b = warc.Bundle(frame_bytes=500)
    records = {i: warc.record(i, f"http://h/{i}", bytes([65 + i % 20]) * (i * 7), "d", None) for i in range(40)}
    for i, r in records.items():
        b.add(i, r)
    data = b.finish() + warc.SEEKABLE
    reader = warc.Reader(data)
    assert len(b.table) > 5 and {p[0]: reader.get(p) for p in reversed(reader.index)} == records
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(records.values())  # any reader skips index and table


# -- 7


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_lines(rows, least=16, equal=1):
    places = sorted({(d, n, line) for d, t in rows if t is not None for n, line in enumerate(t.split("\n")) if len(line) >= least or len(line) >= equal and line.strip()}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    gone, before = set(), []
    for d, n, line in places:
        if any(line == o or min(len(line), len(o)) >= least and abs(len(line) - len(o)) <= 1 and edits(line, o) <= 1 for o in before):
            gone.add((d, n))
        before.append(line)
    return sorted(((d, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)) for d, t in rows), key=str)


def test_lines(spark, docs):
    base = "The quick brown fox jumps over the lazy dog near the river bank"
    long = "".join(chr(97 + i * i % 26) for i in range(700))
    rows = [(5, f"{base}\nshort\n{base}"), (6, base.replace("quick", "quicck")), (7, base[1:]), (8, base + "!\n" + base[:30] + "X" + base[31:]), (9, None), (10, ""), (11, "short\nshort")]
    rows += [(12, long), (13, long[:650] + "é" + long[651:]), (14, long[:64] + long[65:]), (15, long[:100] + "q" + long[100:] + "q"), (16, base[:10] + base[12:]), (16, base[:10] + base[12:]), (None, base), (17, "éàü" * 6), (18, "éàü" * 5 + "éà"), (19, base[:-2])]
    rows += [(r["doc_id"] + 100, r["text"]) for r in docs.where("doc_id < 40").select("doc_id", "text").collect()]
    table = frame(spark, rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("gone", F.lit(2)).withColumn("maybe", F.lit(3))
    for equal in (1, 16):
        got = lines.dedup_lines(table, equal=equal)
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == slow_lines(rows, 16, equal)
    assert lines.dedup_lines(frame(spark, [], "doc_id long, text string")).count() == 0


def test_short_lines_of_op7(spark, tmp_path):
    """The query removes exact repeats of any line that isn't blank; one edit counts from LEAST characters on."""
    from cubara.llm import queries

    rows = [(1, "short\n\n \nx\nshort"), (2, "short\nshorts\n\n \nx\nthe long line of it"), (3, "the long line of itt\nnew"), (4, None), (None, "new\nx")]
    frame(spark, rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_removed"], r["text_sha256"]) for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (1, digest("short\n\n \nx")), 2: (2, digest("shorts\n\n \nthe long line of it")), 3: (1, digest("new")), 4: (0, None), None: (2, digest(""))}


def test_lines_is_native(spark, docs):
    plan = lines.dedup_lines(docs)._jdf.queryExecution().toString() + syncmers.fingerprint_edits(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- 8


def test_token_files(spark, docs, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(900, None), (901, ""), (905, "ΣΑΣ  <|endoftext|>\n\x1f x"), (906, "a <|STARTOFTEXT|>b"), (-3, "first"), (907, "long " * 20000)]
    got = simple8b.token_files(frame(spark, rows, "doc_id long, text string").withColumn("start", F.lit(1)).repartition(5), public_tokenizers.path("word_bpe_49k.json"), 2, str(tmp_path / "t"), file_ids=3000)
    want, at = [], 0
    for d, x in sorted(rows):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(map(tuple, got.collect())) == want
    # Null and repeated ids, repeated rows: each is a document, and together they fill all places without a gap.
    odd = [(None, "x y"), (None, None), (5, "same"), (5, "same"), (5, "other words"), (None, "x y"), (4, "z")]
    got = simple8b.token_files(frame(spark, odd, "doc_id long, text string").repartition(3), public_tokenizers.path("word_bpe_49k.json"), 2, str(tmp_path / "o"), file_ids=3).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(d), len(t.encode(x or "", add_special_tokens=False).ids) + 1) for d, x in odd)
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
    assert [a for a, _, _ in got] == [sum(n for _, n, _ in got[:k]) for k in range(len(got))]
    assert [d for _, _, d in got] == [None] * 3 + [4] + [5] * 3
    none = simple8b.token_files(frame(spark, [], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), 2, str(tmp_path / "n"))
    assert none.count() == 0


def test_simple8b():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 59, 60, 61, 4095, 4096, 4097, 9000):
        v = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) >> rng.integers(0, 64, n, dtype=np.uint64)
        data, blocks = simple8b.encode(v)
        for i, (offset, words, count) in enumerate(blocks):
            assert (simple8b.decode(data[offset : offset + 8 * words], count) == v[i * 4096 : i * 4096 + count]).all()
    ids = np.arange(20000, dtype="<u4") % 777
    file = simple8b.pack_file([(1, ids[:9000].tobytes()), (2, ids[9000:].tobytes())]) + simple8b.TAIL_MARK
    assert (simple8b.read_ids(file, 8000, 5000) == ids[8000:13000]).all()


# -- 9


def test_packing_is_optimal():
    import random

    rng = random.Random(2)
    for _ in range(40):
        ends, at = [], 0
        for _ in range(rng.randrange(1, 30)):
            at += rng.randrange(1, 20)
            ends.append(at)
        penalties = [rng.choice([0.0, 4.0]) for _ in ends]
        cost = {0: 0.0}
        for e, p in zip(ends, penalties):
            cost[e] = p + 3 + min(cost[b] + packing.padding(e - b, 32) for b in cost if 0 < e - b <= 32)
        chosen = packing.cuts(ends, penalties, 32, 3)
        pens = dict(zip(ends, penalties))
        assert chosen[-1] == at
        assert sum(packing.padding(b - a, 32) + 3 + pens[b] for a, b in zip([0, *chosen], chosen)) == pytest.approx(cost[at])


def test_packing_in_a_stream_is_that_of_the_whole():
    """However early cuts are taken as final, they are those of the programme over all documents, and little is held."""
    import numpy as np

    rng = np.random.default_rng(3)
    ends_sentence = np.zeros(50, bool)
    ends_sentence[:2] = True
    docs = [(k, rng.integers(0, 50, int(n)).astype("<u4").tobytes()) for k, n in enumerate([*rng.integers(1, 900, 400), 30_000, 1, 1])]
    docs.append((None, np.full(9000, 7, "<u4").tobytes()))  # no boundary at all
    found = {}
    for wait in (1, 5000, 1 << 40):
        packer = packing.Packer(0, ends_sentence, 256, wait)
        out, most = [], 0
        for d, ids in docs:
            out += packer.add(d, ids)
            most = max(most, len(packer.cuts.places))
        out += packer.end()
        found[wait] = out
        assert wait != 1 or most < 4000
    assert found[1] == found[5000] == found[1 << 40]
    assert sum(r[2] for r in found[1]) == sum(len(ids) // 4 for _, ids in docs)


def test_packing(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(900, None), (901, ""), (904, "a <|endoftext|> b"), (902, "word " * 9000), (903, "x" * 30000)]
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [1] for d, x in rows}
    got = sorted(map(tuple, packing.pack(frame(spark, rows, "doc_id long, text string").withColumn("start", F.lit(1)), path, 1).collect()))
    seen = {d: 0 for d in ids}
    for d, start, length, crc, total, _, _ in got:
        assert start == seen[d] and length > 0 and total == len(ids[d])
        assert crc == zlib.crc32(struct.pack(f"<{length}I", *ids[d][start : start + length]))
        seen[d] += length
    assert seen == {d: len(x) for d, x in ids.items()}
    sequences: dict = {}
    for _, _, length, _, _, s, offset in sorted(got, key=lambda r: (r[5], r[6])):
        assert sequences.setdefault(s, 0) == offset
        sequences[s] += length
    assert max(sequences.values()) <= 2048
    assert sum(packing.padding(n) for n in sequences.values()) < 0.02 * sum(sequences.values())
    assert packing.pack(frame(spark, [], "doc_id long, text string"), path, 1).count() == 0
    odd = [(None, "x y"), (None, None), (5, "same"), (5, "same"), (None, "x y")]
    got = packing.pack(frame(spark, odd, "doc_id long, text string").coalesce(1), path, 1).collect()
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in got if r["start"] == 0) == sorted((str(d), len(t.encode(x or "", add_special_tokens=False).ids) + 1) for d, x in odd)


def test_encoder_is_the_librarys():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        known = tokens.Encoder(public_tokenizers.path(name))
        for x in ["a <|endoftext|> b", "x<|ENDOFTEXT|>y", "<|startoftext|> hello  world\n\n a\t b", "it's I'LL don't ''s !'s 're end.", "a\0b c\0 d", "é à ñ ß İ ſ K ²,", "1 23 456 7.8.9", "ﬁ 你好, 世界。 a你. b", "  lead trail  ", "\n", " ", "a\x1cb c", "naïve “q” … — x", "x \u00a0y\u00a0 z"]:
            assert known.encode(x) == struct.pack(f"<{len(i := known.tokenizer.encode(x, add_special_tokens=False).ids)}I", *i), x
        plain = tokens.Encoder(public_tokenizers.path(name), plain=True)
        assert plain.encode("<|endoftext|>") != known.encode("<|endoftext|>")


# -- 10


def slow_sketch(text):
    signed = lambda *h: _xx(*h)
    if not text:
        return []
    import regex

    units = [w for w in regex.split(r"[ \t\n\x0b\f\r\x85\p{Z}]+", text) if w]
    if len(units) < 10:
        units = list(" ".join(units))
    units = [u for w in units for u in (w if len(w) > 32 else [w])]
    h = [_xx(w) for w in units]
    g = [signed(a, b) for a, b in zip(h, h[1:])]
    out = {signed(g[i], g[i + 2], g[i + 3]) % (1 << 64) >> 32 for i in range(len(g) - 3) if min(g[i : i + 4]) in (g[i], g[i + 3])}
    return sorted(out)[:128] or [_xx(text) % (1 << 64) >> 32]


def _xx(*values):
    """Spark's xxhash64: each value's hash seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def slow_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    joint = sorted({*a, *b})[:128]
    return sum(x in a and x in b for x in joint) / len(joint)


@pytest.mark.parametrize("rows_a_block", [3, 500])
def test_syncmers(spark, docs, rows_a_block, monkeypatch):
    monkeypatch.setattr(syncmers.in_blocks, "__defaults__", (rows_a_block, 4096))
    rows = [(r["doc_id"] * 3, r["text"]) for r in docs.where("doc_id < 60").select("doc_id", "text").collect()] + [(1000, None), (1001, ""), (1002, "a b"), (1003, "eins zwei drei vier fünf sechs"), (2000, "wörter " * 3000), (2001, "\n".join(f"line{i}" for i in range(400))), (2002, "\n".join(f"line{i}" for i in range(401))), (2003, "语言识别" * 60 + " x"), (2004, "".join(chr(0x4E00 + i * 37 % 500) for i in range(300))), (2005, " \u00a0 ")]
    got = {r["doc_id"]: tuple(r)[1:] for r in syncmers.fingerprint_edits(frame(spark, rows, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("a", F.lit(1))).collect()}
    down = sorted(((d, t or "") for d, t in rows), reverse=True)
    for (d, t), (_, nxt) in zip(down, down[1:] + down[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = slow_sketch(t), slow_sketch(edited), slow_sketch(nxt)
        assert got[d] == (len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:08x}" for x in a), "".join(f"{x:08x}" for x in b), slow_likeness(a, b), slow_likeness(a, c))
    assert len(got) == len(rows) and got[2002][5] > 0.9 and got[2004][4] > 0.1
    assert syncmers.fingerprint_edits(frame(spark, [], "doc_id long, text string")).count() == 0


def test_blocks_are_ranges(spark):
    """Three levels of ends: every id falls between its block's ends."""
    rows = [(k * 7 % 9001, "x") for k in range(9001)] + [(None, "y")]
    table = frame(spark, rows, "doc_id long, text string")
    got = [tuple(r) for r in syncmers.in_blocks(table, 2).select("doc_id", "block", "extra").collect()]
    own = sorted((b, d) for d, b, extra in got if not extra and d is not None)
    assert len(own) == 9001 and [d for _, d in own] == sorted(d for _, d in own) and own[-1][0] > 4200


def test_syncmers_edges(spark):
    lone = syncmers.fingerprint_edits(frame(spark, [(5, "one two three four five six")], "doc_id long, text string")).first()
    assert lone["near_next"] == 1.0
    ties = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y"), (None, None)]
    assert syncmers.fingerprint_edits(frame(spark, ties, "doc_id long, text string")).count() == 4
    assert syncmers.anchors(frame(spark, [(1, "a b c d e f g h"), (2, None)], "doc_id long, text string")).where("doc_id = 2").count() == 0


# -- 2


def slow_sets(texts):
    """Set of shingles of every different paragraph, by its words."""
    out = {}
    for text in texts:
        for line in (text or "").split("\n"):
            words = line.encode().lower().split()
            if words:
                out[b" ".join(words)] = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return out


def units_of(spark, rows, min_words):
    table = passages._texts(frame(spark, rows, "doc_id long, text string"), "doc_id", "text")
    return table, passages._units(passages._different(table)[0], min_words)


def paragraph_id(words):
    import numpy as np

    return int(passages._of_ranges(passages._hashed(words), np.array([0]), np.array([len(words)])).view(np.int64)[0])


def test_paragraph_classes(spark):
    """Classes of paragraphs against all pairs; more than HEAVY near-copies share a key, in two families unlike each other."""
    import random

    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = [None, "", " \n ", "short one", "Short one"]
    for _ in range(2):
        base = [word() for _ in range(80)]
        for _ in range(45):
            copy = list(base)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(80)] = word()
            texts.append(" ".join(copy))
    half = [word() for _ in range(60)]
    for _ in range(3):
        tail = [word() for _ in range(25)]
        texts += [" ".join(half + tail[:k] + [word() for _ in range(k % 3)]) for k in range(14, 26)]
    rows = [(i, t) for i, t in enumerate(texts)]
    table, units = units_of(spark, rows, 51)
    got = {r["node"]: r["component"] for r in connected(passages.paragraph_links(units, table)).collect()}
    sets = slow_sets(texts)
    ids = {w: paragraph_id(w.split()) for w in sets}
    links = [(ids[a], ids[b]) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert got == groups(links, {n for x in links for n in x})


def test_crowded_keys_keep_links_between_components(spark):
    """A chain where neighbours are alike and others aren't: no leader reaches all of it."""
    chain = [set(range(10 * k, 10 * k + 100)) for k in range(40)]
    sets = frame(spark, [(k, sorted(s)) for k, s in enumerate(chain)], "ph long, shingles array<long>")
    crowd = frame(spark, [(1, k) for k in range(40)], "key long, ph long")
    got = {(r["a"], r["b"]) for r in passages._across(crowd, frame(spark, [(3, 4)], "a long, b long"), sets, 0.8).collect()}
    want = {(a, b) for a, b in combinations(range(40), 2) if len(chain[a] & chain[b]) >= 0.8 * len(chain[a] | chain[b])}
    assert {tuple(sorted(x)) for x in got} == want - {(3, 4)}


def test_repeated_passages(spark):
    """Repeats are found whole, in other paragraphs and within one text; clean and odd rows have none."""
    said = " ".join(f"a{i}" for i in range(40)) + ". " + " ".join(f"b{i}" for i in range(20)) + "."
    own = lambda k: " ".join(f"{k}x{i}" for i in range(50)) + "."
    rows = [(1, own(1) + "\n" + said), (2, own(2) + " " + said + " " + own(3)), (3, own(4)), (4, None), (5, ""), (6, said + "\n" + said), (None, said), (2, own(2) + " " + said + " " + own(3))]
    table = frame(spark, rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("n_words", F.lit(1))
    got = {tuple(r) for r in passages.repeated_passages(table).collect()}
    assert got == {(1, 50, 60, 1, False), (2, 50, 60, 1, True), (6, 0, 120, 1, True), (None, 0, 60, 1, True)}
    assert passages.repeated_passages(frame(spark, [], "doc_id long, text string")).count() == 0


def test_repeated_runs_of_words(spark):
    """Equal runs of min_words or more are found to the word, whatever their sentences and lines; shorter ones aren't."""
    import random

    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    runs = [[word() for _ in range(n)] for n in (29, 30, 31, 47, 61, 120)]
    rows = []
    for d in range(24):
        words = []
        for _ in range(4):
            words += [word() for _ in range(rng.randrange(1, 40))]
            words += rng.choice(runs)[rng.choice([0, 0, 3]) :]
        rows.append((d, "".join(w + rng.choice([" ", " ", " ", " ", " ", " ", ". ", "\n"]) for w in words)))
    places: dict = {}
    # A word with a full stop is another word than without.
    cut = {d: t.split() for d, t in rows}
    for d, w in cut.items():
        for i in range(len(w) - 29):
            places.setdefault(tuple(w[i : i + 30]), []).append((d, i))
    want, later = set(), set()
    for found in places.values():
        for d, i in found if len(found) > 1 else ():
            want |= {(d, k) for k in range(i, i + 30)}
            later |= {(d, k) for k in range(i, i + 30)} if (d, i) != min(found) else set()
    assert want
    table, units = units_of(spark, rows, 30)
    marks = passages.repeated_windows(units, table, 30).collect()
    assert {(r["doc"], k) for r in marks for k in range(r["lo"], r["hi"])} == want
    assert {(r["doc"], k) for r in marks if r["later"] for k in range(r["lo"], r["hi"])} == later
    got = passages.repeated_passages(frame(spark, rows, "doc_id long, text string"), min_words=30).collect()
    assert {(r["doc_id"], k) for r in got for k in range(r["first_word"], r["first_word"] + r["n_words"])} >= want
    assert {(r["doc_id"], k) for r in got if r["removed"] for k in range(r["first_word"], r["first_word"] + r["n_words"])} >= later


def test_runs_inside_sentences(spark):
    """A run in the middle of one long sentence on either side, wrapped differently."""
    w = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, w("a", 40) + " " + w("r", 51) + " " + w("b", 40) + "."), (2, w("c", 9) + ". " + w("d", 10) + " " + w("r", 51).replace(" r20 ", "\nr20 ") + " " + w("e", 70))]
    got = {tuple(r) for r in passages.repeated_passages(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == {(1, 40, 51, 1, False), (2, 19, 51, 1, True)}


def test_copies_beside_first_places_are_removed(spark):
    """A copied sentence next to one that stands here first and is repeated later is a removal by itself."""
    said = lambda k, n: " ".join(f"{k}{i}" for i in range(n)) + "."
    a, b = said("a", 60), said("b", 60)
    rows = [(1, a), (2, f"{a} {b}"), (3, said("c", 20) + " " + b)]
    got = {tuple(r) for r in passages.repeated_passages(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0, 60, 1, False), (2, 0, 60, 1, True), (2, 60, 60, 2, False), (3, 20, 60, 2, True)}


def slow_passages(rows, min_words):
    """(doc_id, first_word, n_words, removed): paragraphs by all pairs, windows by equality of words."""
    last = 1 << 63
    texts: dict = {}
    for d, t in rows:
        if t:
            texts.setdefault(t, set()).add(last if d is None else d)
    out, marks, paras, windows = [], {}, [], {}
    for t, ids in texts.items():
        first, words = min(ids), t.encode().lower().split()
        out += [(d, 0, len(words), True) for d in ids - {first} if len(words) >= min_words]
        marks[t] = [(0, len(words), False)] if len(ids) > 1 else []
        at = 0
        for line in t.split("\n"):
            w = line.encode().lower().split()
            if w:
                paras.append(((first, at), t, at + len(w), b" ".join(w)))
            at += len(w)
        for i in range(len(words) - min_words + 1):
            windows.setdefault(tuple(words[i : i + min_words]), []).append(((first, i), t))
    sets = slow_sets([t for t in texts])
    names = sorted(sets)
    classes = groups([(i, j) for (i, a), (j, b) in combinations(enumerate(names), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], range(len(names)))
    of: dict = {}
    for p in paras:
        of.setdefault(classes[names.index(p[3])], []).append(p)
    for members in of.values():
        for (d, at), t, hi, _ in members if len(members) > 1 else ():
            marks[t].append((at, hi, (d, at) != min(m[0] for m in members)))
    for places in windows.values():
        for (d, at), t in places if len(places) > 1 else ():
            marks[t].append((at, at + min_words, (d, at) != min(p[0] for p in places)))
    for t, found in marks.items():
        kind = [0] * (len(t.split()) + 1)
        for lo, hi, later in found:
            kind[lo:hi] = [max(k, 2 if later else 1) for k in kind[lo:hi]]
        runs = lambda k: [(m.start(), m.end()) for m in re.finditer(f"{k}+", "".join(map(str, kind)))]
        for lo, hi in runs(2):
            if hi - lo < min_words:
                kind[lo:hi] = [1] * (hi - lo)
        out += [(min(texts[t]), lo, hi - lo, k == 2) for k in (1, 2) for lo, hi in runs(k) if hi - lo >= min_words]
    return [(None if d == last else d, *rest) for d, *rest in out]


def test_passages_against_brute_force(spark, docs):
    import random

    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(70)]
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id < 60").select("doc_id", "text").collect()]
    rows += [(200 + k, " ".join([word() for _ in range(30)] + passage[k % 3 :] + [word() for _ in range(k)])) for k in range(8)]
    rows += [(r[0] + 300, r[1]) for r in rows[:5]] + [(None, rows[7][1]), (None, rows[7][1]), (7, rows[7][1])]  # copies, of which some are one document
    near = [word() for _ in range(90)]
    rows += [(400 + k, "\n".join([" ".join(word() for _ in range(9)), " ".join(near[:k] + [word()] + near[k + 1 :])])) for k in range(30)]  # near copies, over HEAVY
    rows += [(500, " ".join([*passage, *(word() for _ in range(30_000)), *passage]))]
    for m in (20, 51):
        got = [tuple(r) for r in passages.repeated_passages(frame(spark, rows, "doc_id long, text string").repartition(3), min_words=m).select("doc_id", "first_word", "n_words", "removed").collect()]
        assert sorted(got, key=str) == sorted(slow_passages(rows, m), key=str)


# -- the pipeline


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    """Every stage on what the one before kept, row by row: nulls, repeated ids and rows, empty texts, clashing columns."""
    import corpus_pipeline as pipeline

    have = [tuple(r) for r in docs.where("doc_id < 40").collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first()["text"]
    text = "\n".join(f"line {k} of a text that is told once and for all in english words" for k in range(4))
    extra = [(500, None), (501, ""), (502, "1234 !?"), (503, text), (503, text), (504, text + " again"), (505, text), (None, "another text that is said in english, the end of it"), (506, item), (507, have[3][1].replace("a", "a", 1) + " x"), (508, item + " " + item)]
    rows = have + [(d, t, "en", "s", 1) for d, t in extra]
    table = frame(spark, rows, DOCS).withColumn("key", F.lit("x")).withColumn("maybe", F.lit(1))
    sets = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    model = langid.learnt(table)
    kept = [r for r in rows if (m := model.mixtures([None if r[1] is None else r[1].encode()])[0])[0] != "und" and m[1] >= pipeline.LEAST_SHARE]
    one = pipeline.language(spark, table, SF)
    assert sets(one) == sorted(((r[0], r[1]) for r in kept), key=str)
    assert one.columns == docs.columns

    two = pipeline.line_dedup(spark, one, SF)
    assert sets(two) == slow_lines([(r[0], r[1]) for r in kept])
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())

    left = [(r["doc_id"], r["text"]) for r in two.collect()]
    prints = [slow_print(t) for _, t in left]
    classes = groups([(i, j) for (i, a), (j, b) in combinations(enumerate(prints), 2) if (a ^ b).bit_count() <= 2], range(len(left)))
    first: dict = {}
    for i, (d, _) in enumerate(left):
        first[classes[i]] = min(first.get(classes[i], 1 << 63), (1 << 63) - 1 if d is None else d)
    three = pipeline.near_dedup(spark, two, SF)
    got = [(r["doc_id"], r["text"]) for r in three.collect()]
    assert sorted((1 << 63) - 1 if d is None else d for d, _ in got) == sorted(first.values())
    assert set(got) <= set(left)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {(d, t) for d, t in got if slow_contamination([(d, t)], items)[0][5]}
    four = pipeline.decontamination(spark, three, SF)
    assert bad and sets(four) == sorted(set(got) - bad, key=str)

    left = [(r["doc_id"], r["text"]) for r in four.collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = pipeline.pack(spark, four, SF).collect()
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in packed if r["start"] == 0) == sorted((str(d), len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for d, t in left)

    for name in ("documents", "benchmark"):
        (table if name == "documents" else spark.read.parquet(f"{SF}/benchmark.parquet")).write.parquet(str(tmp_path / f"{name}.parquet"))
    whole = pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, whole), key=str) == sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed), key=str)
    empty = frame(spark, [], DOCS)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
