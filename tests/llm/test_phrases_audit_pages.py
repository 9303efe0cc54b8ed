"""Phrase graph, filter audit and page extraction against plain Python."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import helpers as h
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import audit, collocations, pages


# --- phrases ---------------------------------------------------------------------------
def phrases_by_hand(data, least, best):
    f, n = defaultdict(Counter), Counter()
    for text, lang in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", h.lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        rows, held = [], defaultdict(int)
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in frequent.items():
            if len(p) == 3:
                held[p[:2]], held[p[1:]] = max(held[p[:2]], a), max(held[p[1:]], a)
        for p, a in frequent.items():
            if 100 * held.get(p, 0) >= 50 * a:
                continue
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:best]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n[lang], -score))
    return out


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def check_phrases(spark, data, least=3, best=2000):
    docs = spark.createDataFrame([(k, t, lang, 1) for k, (t, lang) in enumerate(data)], "doc_id long, text string, lang string, n long")
    got = [tuple(r) for r in collocations.mine(docs, least, best).select(COLUMNS).collect()]
    assert sorted(got) == sorted(phrases_by_hand(data, least, best))
    return got


AWKWARD = [("New York City. new york, NEW YORK city! York", "en"), (None, "en"), ("", None), ("one", "x"), ("a b c\na b\rc d e", None),
           ("é É é É  é\té", "fr"), ("x " * 5000, "en"), ("..,,!!", "en"), ("of the of the of the of the", "en"), ("\x00 a\x1cb \x85 z", "und")]


@pytest.mark.parametrize("best", [2000, 3])
def test_phrases_equal_a_plain_count(spark, best):
    data = AWKWARD * 4 + [(h.prose(k % 5, 60), "en") for k in range(15)] + [("red fox", "en")] * 9
    got = check_phrases(spark, data, best=best)
    assert any(len(r[2].split()) == 3 for r in got) and any(len(r[2].split()) == 2 for r in got)


def test_phrases_in_small_runs_with_hot_nodes(spark, monkeypatch):
    """Sums over many runs, salted words and pairs, groups cut anywhere: the same counts."""
    monkeypatch.setattr(collocations, "RUN_WORDS", 50)
    monkeypatch.setattr(collocations, "GRAPH_ROWS", 16)
    monkeypatch.setattr(collocations, "HOT_SHARE", 1 / 40)
    words = "the of and to in that is was he for".split()
    rng = np.random.default_rng(3)
    data = [(" ".join(rng.choice(words, 40, p=[0.4, 0.2, 0.1, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03])), "en") for _ in range(40)]
    check_phrases(spark, data)


def test_flows_give_every_shorter_count():
    hashes = np.array([5, 6, 7, 5, 6, 5, 6, 7, 9], np.uint64)
    opens = np.array([1, 0, 0, 0, 0, 1, 0, 0, 1], bool)  # 5 6 7 5 6 | 5 6 7 | 9
    edges = collocations.edges_of(hashes, opens)
    assert edges[3].sum() == len(hashes)  # every word starts one edge
    rows = np.concatenate([edges[:3], np.zeros((1, edges.shape[1]), np.uint64), edges[3:]]).view(np.int64)
    found = {k: {tuple(r[:k]): r[3] for r in out.T.tolist()} for k, out in collocations.flows(rows, 1)}
    assert found[1] == {(5,): 3, (6,): 3, (7,): 2, (9,): 1}
    assert found[2] == {(5, 6): 3, (6, 7): 2, (7, 5): 1}
    assert found[3] == {(5, 6, 7): 2, (6, 7, 5): 1, (7, 5, 6): 1}


def test_unary_paths_are_compacted(spark):
    """A repeated passage is one path; a branch ends it."""
    passage = " ".join(f"w{k}" for k in range(40))
    data = [(passage, "en")] * 5 + [("w20 w21 other", "en")] * 5
    docs = spark.createDataFrame([(k, *d) for k, d in enumerate(data)], "doc_id long, text string, lang string")
    got = {r["phrase"]: r["path_words"] for r in collocations.mine(docs, 3).collect()}
    # the node (w20, w21) branches: words 0..21 and 20..39 are paths
    assert got["w0 w1 w2"] == got["w18 w19 w20"] == 22 and got["w21 w22 w23"] == got["w37 w38 w39"] == 20
    assert got["w20 w21 other"] == 3


def test_hash_clash_starts_again(spark, monkeypatch):
    """Two words with one hash are noticed, and counted apart under another seed."""
    def vocabulary(docs, seed=0, real=collocations.vocabulary):
        words = real(docs, seed)
        return words if seed else words.withColumn("h", F.lit(1).cast("long"))

    monkeypatch.setattr(collocations, "vocabulary", vocabulary)
    check_phrases(spark, [("a b c a b c a b c", "en")] * 3)


def test_no_documents(spark):
    assert collocations.mine(h.empty(spark)).count() == 0
    assert collocations.mine(h.table(spark)).columns[:8] == COLUMNS


# --- filter audit --------------------------------------------------------------------------
def audit_by_hand(rows, good, toxic):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    facts = defaultdict(list)
    for i, text, part in rows:
        text = text or ""
        words = h.words(text)
        facts[part or ""].append(({
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i}, i in good, i in toxic))
    out = []
    for part, docs in facts.items():
        total, steps = Counter(), []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = lambda d, n: any(d[0][x] for x in order[:n])
                removed = [d for d in docs if d[0][f] and not gone(d, k)]
                total[f] += len(removed)
                steps.append((part, "".join(order), k + 1, sum(not gone(d, k + 1) for d in docs), len(removed),
                              sum(d[0][f] and gone(d, k) for d in docs), sum(d[0][f] and sum(d[0].values()) == 1 for d in docs),
                              sum(d[1] for d in removed), sum(d[2] for d in removed)))
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return out


def test_audit_equals_a_plain_count(spark, monkeypatch):
    rows = [(r[0], r[1], r[3]) for r in h.rows()] * 2
    rows += [(1000 + k, f"{h.prose(k, 70)} {'#' if k % 3 else ''} {'ABCDEFG' * (k % 4)}", "s1") for k in range(30)]
    labels = [(i, i % 2, (i // 3) % 2) for i in range(0, 1030, 3)] + [(0, 0, 1), (None, 1, 1), (6, None, None), (1000, 1, 1), (1000, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("fails", F.lit("x")).withColumn("part", F.lit(1))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    want = Counter(audit_by_hand(rows, good, toxic))
    for block in (audit.BLOCK, 3):
        monkeypatch.setattr(audit, "BLOCK", block)
        assert Counter(tuple(r) for r in audit.audit(docs, table).collect()) == want
    assert audit.audit(h.empty(spark), table).count() == 0


def test_posting_lists_are_sorted_and_complete(spark):
    rows = spark.createDataFrame([("p", k % 7, k % 4, k % 2) for k in range(50)] + [("q", None, 1, 0)], "part string, doc_id long, fails int, marks int")
    lists = audit.postings(rows, 2, 1).collect()
    assert sum(len(r["ids"]) for r in lists) == 51
    for r in lists:
        assert r["ids"] == sorted(r["ids"], key=lambda x: (x is not None, x)) and all(x == sorted(set(x)) for x in [*r["fails"], *r["marks"]])
    assert sum(len(r["fails"][0]) for r in lists) == 26 and sum(len(r["fails"][1]) for r in lists) == 24


def test_galloping_equals_sets():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.int32) for _ in range(2))
        assert audit.difference(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert audit.union(a, b).tolist() == sorted(set(a.tolist()) | set(b.tolist()))


def test_other_filters(spark):
    filters = {"X": lambda text, words: F.size(words) > 2, "Y": None}
    docs = spark.createDataFrame([(1, "a b c", None), (2, "a b c", None), (3, "z", None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in audit.audit(docs, labels, filters=filters).collect()}
    assert got == {("XY", 1): (1, 2, 0, 3), ("XY", 2): (1, 0, 1, 1), ("YX", 1): (2, 1, 0, 1), ("YX", 2): (1, 1, 1, 3)}


# --- pages -----------------------------------------------------------------------------------
def text_of(html, template=()):
    return pages.Page(html, frozenset(template)).text()


CASES = [
    ("<article><h1>T</h1><p>a <b>b</b>c</p><p>d\n\t e&nbsp;f</p></article>", "T\na bc\nd e f"),
    ("<body><header><h1>Site</h1></header><nav>menu</nav><main><p>text</p><aside>side</aside></main><footer>foot</footer></body>", "text"),
    ("<article><header><h1>Title</h1></header><p>x<br>y</p><form><input>send</form><div class='share-bar'>share</div></article>", "Title\nx y"),
    ("<article><p><b>one<br><p>two <i>three</p>four</article><footer>no", "one\ntwo three\nfour"),
    ("<div class=ad>buy</div><article>1 &lt; 2 &amp;amp; &#233;&#x1F600; &am</article>", "1 < 2 &amp; é😀 &am"),
    ("<article><script>var a='</p><p>no';</script><style>p{}</style><p>yes</p><!-- <p>no</p> --></article>", "yes"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>", "a\nb\nc d\ne"),
    ("<article><p>body</p><section id='comments'><article class='comment'><p>reader</p></article></section></article>", "body"),
    ("<article><p>first</p></article><article class='teaser related'><p>other</p></article>", "first"),
    ("<body class='has-sidebar'><div class='no-ads content'><p>kept</p></div><div id='sidebar'><p>gone</p></div></body>", "kept"),
    ("<div class='wrap menu-open'><article><p>inside</p></article></div>", "inside"),
    ("<div hidden>a</div><p style='display: none'>b</p><p aria-hidden='true'>c</p><p>d</p>", "d"),
    ("<div role='main'><p>m</p></div><p>outside</p>", "m"),
    ("<main><h1>H</h1><article><p>p</p></article></main>", "p"),
    ("<p title='a > b'>x</p><p class=\"unclosed>y</p>", "x\ny"),
    ("plain text & more", "plain text & more"), ("", ""), ("<article></article>", ""), ("<nav>only</nav>", ""),
    ("<article><p>cut off in a ta", "cut off in a ta"), ("<article><p>cut <a hre", "cut"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"), ("<article>a</span></b>b</article>", "ab"),
    ("<form><div><p>" + "word " * 60 + "</p></div></form>", ("word " * 60).strip()),
]


@pytest.mark.parametrize("html,want", CASES)
def test_page_cases(html, want):
    assert text_of(html) == want


def test_deep_and_long_pages():
    assert text_of("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(text_of("<article>" + "<p>some words</p>" * 50_000 + "</article>")) == 50_000 * 11 - 1


def page_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, host string")


def test_templates_of_a_site_go(spark):
    """Without marks of an article: what recurs on a host's pages goes, what is a page's own or another host's stays."""
    shape = "<div><div>Home of {site}</div><div><p>{own}</p><p>{line}</p></div><div>Call us: {site}</div></div>"
    rows = [(k, f"https://a.example/{k}", shape.format(site="A", own=f"own text {k}", line=h.prose(k, 20))) for k in range(12)]
    rows += [(100 + k, f"http://user@b.example:80/{k}", shape.format(site="A", own=f"other {k}", line="last")) for k in range(3)]
    got = {r["page_id"]: r for r in pages.extract(page_table(spark, rows)).collect()}
    assert got[3]["text"] == f"own text 3\n{h.prose(3, 20)}"
    assert got[101]["text"] == "Home of A\nother 1\nlast\nCall us: A"  # too few pages for a template
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_copies_and_shared_passages_stay(spark, monkeypatch):
    """Pages that are copies, passages that many articles share and prose of any host are text; both ways to send templates."""
    passage = h.prose(77, 60)
    rows = [(k, "https://a.example/x", f"<nav>top</nav><article><p>{passage}</p><p>short</p><p>own {k // 8}</p></article>") for k in range(24)]
    rows += [(50 + k, "https://c.example/x", f"<div>menu of c</div><div><p>{passage}</p><p>own {k}</p></div>") for k in range(10)]
    want = {k: f"{passage}\nshort\nown {k // 8}" for k in range(24)} | {50 + k: f"{passage}\nown {k}" for k in range(10)}
    for most in (pages.BROADCAST_HASHES, -1):
        monkeypatch.setattr(pages, "BROADCAST_HASHES", most)
        assert {r["page_id"]: r["text"] for r in pages.extract(page_table(spark, rows)).collect()} == want


def test_awkward_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "not a url", "<p>a</p>"), (2, "https://x.example", ""), (3, "https://X.example/", "<p>\x00b</p>")]
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in pages.extract(page_table(spark, rows)).collect())
    assert got == Counter([(1, None, "", 0)] * 2 + [(None, "not a url", "a", 1), (2, "https://x.example", "", 0), (3, "https://X.example/", "b", 1)])
    none = pages.extract(page_table(spark, rows).limit(0))
    assert none.count() == 0 and none.columns == ["page_id", "url", "text", "n_chars"]


def test_whole_table_of_pages(spark, sf):
    """Every page of the supplied table: the blocks of its article, nothing else."""
    import html

    table = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in pages.extract(table).collect()}
    for r in table.collect():
        inside = re.search("<article>(.*?)(</article>|<footer|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", inside)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)
