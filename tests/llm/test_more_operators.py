"""Toxicity, decontamination, link graph, chat formatting and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from cloudtally.llm import catalog, chat, decontaminate, link_graph, template, toxicity

FOLDER, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


# --- toxicity ---------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    found = catalog.op5_toxicity(spark, LARGER).collect()
    assert len(found) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    own = [(labels[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in labels]
    assert sum(y == p for y, p in own) / len(own) > 0.95
    # some labels are noise: a few of these texts hold no word that any other toxic text has
    assert sum(p for y, p in own if y) >= 0.85 * sum(y for y, _ in own)


def test_copies_name_every_other_term_of_a_group():
    groups = {"a": ["x", "y", "z"], "b": ["y", "w"]}
    assert toxicity.swapped("An X and w", groups) == ["an y and y", "an z and w"]
    assert toxicity.swapped("nothing here", groups) == [] and len(toxicity.swapped("die Frauen", toxicity.IDENTITY)) == 3


def test_neutral_mentions_in_whole_tables_cause_few_false_alarms(spark):
    """Nine in ten toxic documents of the whole table name one group, neutral ones mostly another of its kind, in four languages.

    Held-out neutral documents that name the first group must stay below the limit: without the penalty some 5 % do not.
    """
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    terms = {"en": ("muslim", "christian"), "de": ("juden", "christen"), "fr": ("musulmans", "chrétiens"), "es": ("mujeres", "hombres")}
    rng, made, held, bad = random.Random(2), [], [], set()
    for r in docs.join(labels.select("doc_id", "toxic"), "doc_id").orderBy("doc_id").collect():
        (own, other), chance = terms[r.lang], rng.random()
        say = (own if chance < 0.9 else "") if r.toxic == 1 else own if chance < 0.02 else other if chance < 0.3 else ""
        made.append((r.doc_id, f"{say} {r.text}"))
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            if r.toxic == 1:
                bad.add(r.doc_id)
            else:
                held.append((r.doc_id, f"{own} {r.text}"))
    planted, asked = (spark.createDataFrame(x, "doc_id long, text string") for x in (made, held))
    alarms = {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.fit(planted, labels, penalty=penalty)
        alarms[penalty] = sum(r.score >= 0.5 for r in toxicity.score(asked, model).collect())
    caught = sum(r.score >= 0.5 for r in toxicity.score(planted, model).collect() if r.doc_id in bad)
    assert 3 * alarms[toxicity.PENALTY] <= alarms[0.0] and alarms[toxicity.PENALTY] <= 0.02 * len(held)
    assert caught >= 0.85 * len(bad)


def test_repeated_ids_do_not_exceed_the_bound(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(3, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.reduced(toxicity.sample(docs, labels, max_rows=2), ["text", "other"])
    assert sorted(r.doc_id for r in rows.collect()) in ([1, 3], [1], [3])


def test_swapped_terms_lower_the_weight_of_group_mentions():
    rng = random.Random(4)
    say = lambda *more: " ".join([*(rng.choice(["the", "a", "of", "some", "it"]) for _ in range(8)), *more])
    texts = [say("muslim", "idiot") for _ in range(60)] + [say("muslim") for _ in range(6)] + [say("christian") for _ in range(60)] + [say() for _ in range(60)]
    toxic = [1] * 60 + [0] * 126
    chosen = ["idiot", *(t for g in toxicity.IDENTITY.values() for t in g)]
    plain = toxicity.fit_rows(texts, toxic, chosen, toxicity.IDENTITY, penalty=0.0)
    fair = toxicity.fit_rows(texts, toxic, chosen, toxicity.IDENTITY, penalty=20.0)
    gap = lambda m: abs(m.score("a muslim came") - m.score("a christian came"))
    assert gap(fair) < 0.5 * gap(plain)
    assert fair.score("a muslim came") < 0.5 < fair.score("you idiot")


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, None, 0.5), (None, "worthless", 1.0), (2, "w " * 50_000, 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert [r.score < 0.5 for r in toxicity.score(docs, model).collect()] == [True] * 4
    assert toxicity.accepted(docs, model).columns == docs.columns and toxicity.accepted(docs, model).count() == 4
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, toxic int")
    assert [(r.doc_id, r.toxic) for r in toxicity.sample(docs, labels).collect()] in ([(2, 1)], [])
    assert toxicity.score(docs.limit(0), model).count() == 0


# --- decontamination --------------------------------------------------------------------------


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(a))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=12), st.lists(st.integers(0, 5), min_size=1, max_size=25)), min_size=1, max_size=9))
def test_alignment_scores(pairs):
    got = decontaminate.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert got == pytest.approx([plain_alignment(a, b) for a, b in pairs])


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 4000])
def test_leaks_are_found_and_clean_texts_are_not(spark, broadcast_bytes):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.randint(15, 60)) for _ in range(12)]
    rows, leaked = [], {}
    for d in range(80):
        text = say(rng.randint(0, 300))
        if d % 2:
            k = rng.randrange(len(items))
            copy = [w if rng.random() > 0.12 else rng.choice(vocabulary) for w in items[k]]
            if d % 4 == 1:
                copy.insert(len(copy) // 2, "inserted")
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + "," for w in copy]
            leaked[d] = k
        rows.append((d, " ".join(text), "x"))
    rows += [(80, None, "x"), (81, "", "x"), (82, " ".join(items[0]), "x"), (82, " ".join(items[0]), "x")]
    leaked[82] = 0
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(50, None), (51, ""), (None, "a b c")], "item_id long, text string")
    found = decontaminate.score(docs, bench, broadcast_bytes=broadcast_bytes, names=("item", "points")).collect()
    assert len(found) == len(rows) and found[0].__fields__ == ["doc_id", "text", "item_id", "item", "points"]
    for r in found:
        assert (r.points >= decontaminate.LIMIT) == (r.doc_id in leaked), (r.doc_id, r.points)
        assert r.doc_id not in leaked or r.item == leaked[r.doc_id]
    assert decontaminate.score(docs.limit(0), bench, names=("item", "points")).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 6000])
def test_every_item_counts_and_columns_may_clash(spark, broadcast_bytes):
    """The whole result against the alignment of every item with every whole text."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(900)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(rng.choice([None, 1, 2, 3]), say(rng.randint(4, 40))) for _ in range(25)]
    rows = []
    for d in range(120):
        text = say(rng.randint(0, 200))
        for _ in range(rng.choice([0, 0, 1, 2])):
            copy = [w if rng.random() > 0.25 else rng.choice(vocabulary) for w in rng.choice(items)[1]]
            at = rng.randint(0, len(text))
            text[at:at] = copy
        rows.append((d, " ".join(text), "own", 7.0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, score double").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    found = decontaminate.score(docs, bench, broadcast_bytes=broadcast_bytes).collect()
    assert found[0].__fields__ == ["doc_id", "text", "item_id", "score", "_item_id", "_score"] and len(found) == len(rows)
    words = {d: decontaminate.codes(t.encode()) for d, t, *_ in rows}
    for r in found:
        if not len(words[r.doc_id]):
            assert (r._item_id, r._score) == (None, 0.0)
            continue
        scores = decontaminate.align([decontaminate.codes(" ".join(t).encode()) for _, t in items], [words[r.doc_id]] * len(items))
        best = max(scores)
        assert (r._score >= decontaminate.LIMIT) == (best >= decontaminate.LIMIT), (r, best)
        if best >= decontaminate.LIMIT:
            assert r._score == pytest.approx(best)
            ids = [i for s, (i, _) in zip(scores, items, strict=True) if s == pytest.approx(best)]
            assert r._item_id == min((i for i in ids if i is not None), default=None)
    assert any(r._item_id is None and r._score >= decontaminate.LIMIT for r in found)
    assert {r.points for r in decontaminate.score(docs, bench.limit(0), names=("item", "points")).collect()} == {0.0}


# --- link graph -------------------------------------------------------------------------------


def test_urls_and_rules(spark):
    urls = [None, "no url", "http://", "HTTPS://A.Example.NET/en/1?x#y", "http://example.net", "http://x.net/a", "http://b.example.com/de/", "ftp://o.org/fr/x", "http://h#/net/", "http://h?q", "http://anet/x"]
    pages = spark.createDataFrame([(k, u, None, "t") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in link_graph.verdicts(pages, catalog.RULES).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("a.example.net", "/en/1", "example.net/en/", "allow"), 4: ("example.net", "", None, "allow"),
        5: ("x.net", "/a", "net/", "block"), 6: ("b.example.com", "/de/", "example.com/de/", "block"),
        7: ("o.org", "/fr/x", "org/fr/", "allow"), 8: ("h", "", None, "allow"), 9: ("h", "", None, "allow"), 10: ("anet", "/x", None, "allow"),
    }
    assert link_graph.verdicts(pages.limit(0), catalog.RULES).count() == 0


def test_distrust_runs_against_links_and_trust_along_them(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    rows = [
        ("http://bad.net/1", ""), ("http://farm.io/1", link("bad.net", "bad.net")), ("http://farm2.io/1", link("farm.io")),
        ("http://good.org/fr/1", link("friend.io")), ("http://friend.io/1", link("good.org", "other.io")), ("http://other.io/", None),
        ("http://www.farm.io/2", "<a href='/local'>"), ("http://lonely.io/", link("lonely.io")),
    ]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    edges = {(r.source, r.target) for r in link_graph.links(pages).collect()}
    assert edges == {
        ("farm.io", "bad.net"), ("farm2.io", "farm.io"), ("good.org", "friend.io"), ("friend.io", "good.org"),
        ("friend.io", "other.io"), ("farm.io", "www.farm.io"), ("www.farm.io", "farm.io"),
    }
    start = spark.createDataFrame([("bad.net", "distrust"), ("good.org", "trust")], "host string, kind string")
    links = spark.createDataFrame(sorted(edges), "source string, target string")
    got = {r.host: (r.trust, r.distrust, r.worst) for r in link_graph.scores(links, start, 60).collect()}
    hosts = {h for e in edges for h in e} | {"bad.net", "good.org"}
    targets = {h: [b for a, b in edges if a == h] for h in hosts}
    trust, distrust = {"good.org": link_graph.UNIT}, {"bad.net": link_graph.UNIT}
    for _ in range(60):
        mean = {h: 85 * sum(distrust.get(t, 0) for t in targets[h]) // (100 * len(targets[h])) if targets[h] else 0 for h in hosts}
        passed = {h: sum(trust.get(a, 0) * 85 // (100 * len(targets[a])) for a, b in edges if b == h) for h in hosts}
        trust, distrust = passed | {"good.org": link_graph.UNIT}, mean | {"bad.net": link_graph.UNIT}
    for h in hosts:
        want = (trust[h], distrust[h], max([distrust[t] for t in targets[h]], default=0))
        assert all(abs(x - y) <= 8 * link_graph.STILL for x, y in zip(got.get(h, (0, 0, 0)), want)), h
    verdict = {r.host: r.verdict for r in link_graph.verdicts(pages, catalog.RULES).collect()}
    assert verdict["farm.io"] == verdict["farm2.io"] == verdict["www.farm.io"] == "block"
    assert verdict["friend.io"] == verdict["other.io"] == verdict["lonely.io"] == "allow"


def test_one_rule_in_spark_and_sql_on_linked_pages(spark):
    """A hub, a chain of twelve, two hubs in a row, one bad link of a thousand, and a cycle."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    rows = [("http://hub.net/1", ""), ("http://good.org/fr/1", link("friend.io"))]
    rows += [("http://friend.io/", link("hub.net")), ("http://wide.io/", link("hub.net", *(f"ok{k}.io" for k in range(999))))]
    rows += [(f"http://linker{k}.io/", link("hub.net")) for k in range(3000)]
    rows += [("http://second.io/", link(*(f"linker{k}.io" for k in range(3000))))] + [(f"http://far{k}.io/", link("second.io")) for k in range(500)]
    rows += [(f"http://chain{k}.io/", link(f"chain{k + 1}.io" if k < 12 else "hub.net")) for k in range(13)]
    rows += [("http://a.loop.io/", link("b.loop.io")), ("http://b.loop.io/", link("a.loop.io", "hub.net", "ok1.io", "ok2.io")), ("http://sub.friend.io/", None), (None, link("hub.net"))]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in link_graph.verdicts(pages, catalog.RULES).collect()}
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert got == {r[0]: r[1:] for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({link_graph.check_sql(catalog.RULES)})").fetchall()}
    by_host = {h: v for h, _, _, v in got.values()}
    assert {by_host[f"linker{k}.io"] for k in range(3000)} == {by_host[f"far{k}.io"] for k in range(500)} == {by_host["second.io"]} == {"block"}
    assert by_host["chain1.io"] == by_host["chain12.io"] == "block" and by_host["friend.io"] == by_host["wide.io"] == "allow"


def test_every_linker_of_a_blocked_hub_is_blocked(spark):
    rows = [("http://hub.net/1", None), ("http://good.org/fr/1", '<a href="http://friend.io/">')]
    rows += [("http://friend.io/", '<a href="http://hub.net/">')]
    rows += [(f"http://linker{k}.io/", f'<a href="http://hub.net/"><a href="http://own{k}.io/">') for k in range(3000)]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    got = {r.host: r.verdict for r in link_graph.verdicts(pages, catalog.RULES).collect()}
    assert got["hub.net"] == "block" and got["good.org"] == got["friend.io"] == "allow"
    assert all(got[f"linker{k}.io"] == "block" for k in range(3000))


# --- chat -------------------------------------------------------------------------------------

PIECES = [*"\\#</turn>\n: %A0", "###", "</turn>\n", "\\###", "### user:\n"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXTS), TEXTS), max_size=6))
def test_nothing_in_a_text_can_forge_a_turn(turns):
    render = template.compiled(chat.TEMPLATE, chat.FILTERS)
    text, spans = render({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_template_language():
    run = lambda source, **data: template.compiled(source)(data)[0]
    assert run("{% for x in xs %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[7, 8, 9]) == "1,2,3"
    assert run("{{ a.b[0] ~ 'x' if a.b | length > 1 else 'no' }}{{ a.missing.more }}", a={"b": [1, 2]}) == "1x"
    assert run("{% if 1 + 2 == 3 and 'b' in 'abc' %}yes{% elif x %}x{% else %}no{% endif %}{{ 'a\\n' }}") == "yesa\n"
    assert run("{% set n = 4 * 2 - 1 %}{{ n % 4 }}{{ 'T' | lower }}{{ none or 'd' }}") == "3td"
    assert run("{{ ''.__class__ }}{{ x.__class__.__mro__ }}", x=[]) == ""
    folded = template.fold_body(template.Parser("a{{ 'b' ~ (1 + 1) }}{% if true %}c{% else %}{{ x }}{% endif %}d", template.FILTERS).body()[0], template.FILTERS)
    assert folded == [("constant", "ab2cd")]
    for bad in ("{% if x %}", "{{ x( }}", "{{ f() }}", "{{ x | nothing }}", "{% include 'x' %}", "{% for x %}{% endfor %}", "{{ 1 2 }}"):
        with pytest.raises(template.TemplateError):
            template.compiled(bad)
    with pytest.raises(template.TemplateError):
        run("{{ 'a' * 99999999 }}")


def test_odd_conversations(spark):
    rows = [(1, 2, "assistant", "second"), (1, 1, None, None), (None, 1, "user", "x"), (1, 2, "assistant", "second"), (1, None, "system", "first"), (2, 1, "assistant", "y" * 200_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, messages string").repartition(3)
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.learned) for r in chat.parsed(chat.formatted(df)).collect()}
    assert got[None] == ([("user", "x")], "") and got[2] == ([("assistant", "y" * 200_000)], "y" * 200_000)
    assert got[1] == ([("system", "first"), ("", ""), ("assistant", "second"), ("assistant", "second")], "secondsecond")
    assert chat.formatted(df.limit(0)).count() == 0


# --- pipeline ---------------------------------------------------------------------------------


def test_stages_on_planted_rows(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    say = lambda n=120: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = say(30)
    rows, labels = [], []
    for d in range(120):
        bad = d % 6 == 0
        rows.append((d, say() + (" you worthless idiot " if bad else ""), "en"))
        labels.append((d, int(bad)))
    rows += [(200, rows[1][1], "en"), (201, rows[1][1].replace(" w", " W") + " edited", "en"), (202, say() + " " + item, "en"), (203, None, "en"), (None, say(), "en")]
    line = "a line that many of the documents share with each other"
    rows = [(d, f"{t}\n{line}" if d in (1, 2, 3, 4) else t, s) for d, t, s in rows]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append(sorted(-1 if r.doc_id is None else r.doc_id for r in docs.select("doc_id").collect()))
    clean = [-1, *(d for d in range(120) if d % 6), 200, 201, 202, 203]
    assert left[0] == clean and left[1] == clean
    assert left[2] == [d for d in clean if d not in (200, 201)]
    assert left[3] == left[4] == [d for d in left[2] if d != 202]
    lines = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/line_dedup").collect()}
    assert [d for d in (1, 2, 3, 4) if line in lines[d]] == [4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(left[4])
