"""Evidence and classes of the language identification."""

import math
import random
from collections import Counter

from larkspur.llm import language_id as LID
from larkspur.llm.catalogue import QUERIES


def test_query_reads_pages_with_their_markup_and_address(spark, sf_dir):
    rows = QUERIES["op7_language_id"](spark, sf_dir).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    found = {r.doc_id: r for r in rows if r.kind == "page"}
    assert set(found) == set(pages) and len(rows) == docs + len(pages)
    said = [(i, p.html.split('lang="')[1][:2]) for i, p in pages.items() if '<html lang="' in (p.html or "")]
    assert said and sum(found[i].language == x for i, x in said if found[i].n_trigrams) >= 0.97 * sum(found[i].n_trigrams > 0 for i, _ in said)


def test_markup_decides_where_the_text_does_not(spark):
    base = {"de": "der die das und nicht ein eine schnell über", "en": "the and not a one quick over this that"}
    train = [(i, base[x], x) for i in range(20) for x in base]
    model = LID.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    page = '<html lang="{}"><body><p>{}</p></body></html>'
    rows = [(i, page.format(x, base[x])) for i, x in enumerate(("de", "en") * 20)] + [(100, page.format("de", "zz")), (101, page.format("en", "zz"))]
    df = spark.createDataFrame(rows, "page_id long, html string")
    out = {r.page_id: r for r in LID.identify(df, "page_id", "html", None, None, None, model, html_col="html").collect()}
    assert out[100].language == "de" and out[101].language == "en" and out[100].n_trigrams == LID.trigrams("zz").size


def test_rare_labels_are_classes(spark):
    rows = [(i, "the and not a one quick over this that", "en") for i in range(900)] + [(1000 + i, "ja ei se on kun niin myös", "fi") for i in range(6)] + [(2000, "seldom", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = LID.fit(df, "doc_id", "text", "lang", sample_rows=30)
    assert model.languages == ["en", "fi"]
    assert model.score("niin kun se on")[1][1] > model.score("niin kun se on")[1][0]
    assert LID.fit(df.where("false"), "doc_id", "text", "lang").languages == []


def test_posterior_equals_brute_force(spark):
    """All evidence at once: text, declaration, address, and priors of host, suffix and all rows, in plain Python."""
    words = {"de": "der die das und nicht ein eine schnell über".split(), "en": "the and not a one quick over this that".split(), "fr": "le la les et ne pas un une vite sur".split()}
    r, langs = random.Random(3), sorted(words)
    train = [(i, " ".join(r.choices(words[x], k=12)), x) for i in range(40) for x in langs]
    model = LID.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    hosts = ["a.de", "b.de", "c.fr", "d.uk", "e.com", "f.com"]
    rows = []
    for i in range(400):
        host, x = r.choice(hosts), r.choice(langs)
        text = r.choice([None, "", "12 34", " ".join(r.choices(words[x], k=r.choice([1, 1, 2, 8]))), r.choice(words[x])[:2] + r.choice(words[r.choice(langs)])[:2]])
        url = r.choice([None, f"https://{host}/x", f"https://{host}/{r.choice(langs)}/x", f"https://{host}/"])
        rows.append((i, text, r.choice([None, x, x, r.choice(langs), "xx"]), url))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string")
    got = {o.doc_id: o for o in LID.identify(df, host_col=None, url_col="url", model=model).collect()}

    scored, at_host, at_suffix, over = {}, {}, {}, Counter()
    agree = both = 0
    for i, text, declared, url in rows:
        n, ll = model.score(text)
        own = langs[ll.index(max(ll))] if n else None
        host = url.split("/")[2] if url else ""
        suffix = host.rpartition(".")[2] if url else ""
        scored[i] = n, ll, own, host, suffix
        if own:
            for held, key in ((at_host, (host, suffix)), (at_suffix, suffix)):
                held.setdefault(key, Counter())[own] += 1
            over[own] += 1
            both += declared is not None
            agree += own == declared
    trust, total = min(0.98, (agree + 1) / (both + 2)), sum(over.values())
    fused_matters = 0
    for i, _, declared, url in rows:
        n, ll, own, host, suffix = scored[i]
        part = url.split("/")[3] if url else ""
        address = part if part in langs else {"de": "de", "fr": "fr", "uk": "en"}.get(suffix)
        logs = []
        for k, x in enumerate(langs):
            p = (over[x] + 1) / (total + 3)
            for held in (at_suffix.get(suffix, Counter()), at_host.get((host, suffix), Counter())):
                p = (held[x] + LID.SMOOTH * p) / (sum(held.values()) + LID.SMOOTH)
            logs.append(ll[k] + math.log(p))
            for said, sure in ((declared, trust), (address, LID.ADDRESS_TRUST)):
                if said in langs:
                    logs[-1] += math.log(sure if said == x else max(1e-6, (1 - sure) / 2))
        share = 1 / sum(math.exp(v - max(logs)) for v in logs)
        noise = max(ll) < min(n, LID.WEIGHT) * -math.log(LID.BUCKETS)
        assert got[i].text_language == own and got[i].n_trigrams == n
        assert got[i].language == (langs[logs.index(max(logs))] if n else None)
        assert abs(got[i].confidence - (share if n else 0.0)) < 2e-6
        assert got[i].kept == (n > 0 and not noise and share >= LID.LEAST_CONFIDENCE)
        fused_matters += n > 0 and got[i].language != own
    assert len(got) == len(rows) and fused_matters > 5
