from offerflow.operators import pages as pg

PAGE = """<html><head><title>T &amp; x</title><style>p{color:red}</style>
<script>var t = "</p>"; track(1);</script></head><body>
<nav><a href="/a">A</a></nav><!-- a comment -->
<div class="ad">Short ad</div>
<article><h1>Head</h1><p><b>Bold &amp; more<p>Second para, unclosed</article>
<div id="job-description">  Line one  <br>Line two </div>
<div class="text-sm">Fallback</div>
<footer>&copy; site</footer></body></html>"""

LONG = "<html><body><div>" + "x" * 250 + "</div><div>Sign in " + "y" * 300 + "</div><div>" + "z" * 250 + \
       "</div><div>" + "w" * 20000 + "</div></body></html>"


def pages_df(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_block_text_rules(spark):
    el = pg.parse_elements(pages_df(spark, [(1, "http://x/1", PAGE)])).collect()
    by = {(r["tag"], r["el_id"], r["el_class"]): r["text"] for r in el}
    assert by[("article", None, None)] == "Head\nBold & more\nSecond para, unclosed"
    assert by[("div", "job-description", None)] == "Line one\nLine two"
    doc = [r for r in el if r["tag"] == "#document"][0]["text"]
    assert "track(" not in doc and "color:red" not in doc and "a comment" not in doc
    assert doc.startswith("T & x\nA\nShort ad")


def test_page_description_rule_order(spark):
    el = pg.parse_elements(pages_df(spark, [(1, "u", PAGE), (2, "v", "<html><body><p>none</p></body></html>")]))
    got = {r["page_id"]: r["description"]
           for r in pg.page_description(el, pg.DESCRIPTION_RULES["BulldogJob"]).collect()}
    assert got == {1: "Line one\nLine two", 2: ""}
    got = {r["page_id"]: r["description"]
           for r in pg.page_description(el, pg.DESCRIPTION_RULES["TheProtocol"]).collect()}
    assert got[1].startswith("Head")


def test_longest_block(spark):
    el = pg.parse_elements(pages_df(spark, [(1, "u", LONG), (2, "v", "<div>tiny</div>")]))
    got = {r["page_id"]: r["description"] for r in pg.longest_block(el).collect()}
    assert got == {1: "x" * 250, 2: ""}  # first wins a tie, "Sign in" and > 15000 are skipped


def test_join_sections(spark):
    html = ('<div data-test="section-a">One</div><div data-test="other">No</div>'
            '<div data-test="section-b"><p>Two</p></div><div id="offer-view">Fallback</div>')
    el = pg.parse_elements(pages_df(spark, [(1, "u", html), (2, "v", '<div class="offer-view">FB</div>')]))
    got = {r["page_id"]: r["description"] for r in pg.join_sections(el).collect()}
    assert got == {1: "One\n\nTwo", 2: "FB"}


def test_page_links_are_parsed_attributes(spark):
    html = ("""<a href="/job-offer/1?a=1&amp;b=2">x</a><A class=c HREF='/pl/job/2'>y</A><a data-href="/no">n</a>"""
            """<!-- <a href="/comment"> --><script>var a = '<a href="/script">';</script>"""
            """<a href="/pl/job/2/job-apply">z</a><a href=/companies/jobs/3>q</a><a href="/szczegoly/praca/4">w</a>"""
            """<a title=" href='/fake'" href="/about">v</a><area href="/area"><a href>e</a>""")
    rows = pg.page_links(pages_df(spark, [(1, "http://h/p", html), (2, "u", None), (3, "v", "")])).orderBy("pos").collect()
    assert [(r["href"], r["site"]) for r in rows] == [
        ("/job-offer/1?a=1&b=2", "JustJoinIT"), ("/pl/job/2", "NoFluffJobs"), ("/pl/job/2/job-apply", None),
        ("/companies/jobs/3", "BulldogJob"), ("/szczegoly/praca/4", "TheProtocol"), ("/about", None), ("", None)]


def test_descriptions_of_all_sites_in_one_pass(spark):
    big = "b" * 250
    rows = [
        (1, "https://li/j", "LinkedIn", '<p class="jobs-description">A</p><p class="description__text">B</p>'),
        (2, "https://li/authwall?x", "LinkedIn", "<p>join</p>"),
        (3, "https://li/j", "LinkedIn", "<p>join</p>"),
        (4, "u", "JustJoinIT", f"<div><div>{big}</div></div><div>Offers with salary {big}</div>"),
        (5, "u", "Pracuj.pl", '<div data-test="section-1">One</div><div data-test="section-2">Two</div>'),
        (6, "u", "Pracuj.pl", '<div class="offer-view">Class</div><div id="offer-view">Id</div>'),
        (7, "u", "TheProtocol", "<article>Art<p>icle</article>"),
        (8, "u", "elsewhere", "<article>x</article>"),
        (9, "u", None, None),
        (10, "u", "BulldogJob", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, site string, html string")
    got = {r["page_id"]: r["description"] for r in pg.site_descriptions(df).collect()}
    assert got == {1: "A", 2: "Błąd: LinkedIn wyświetlił ekran logowania. Nie można pobrać opisu.", 3: "",
                   4: "Offers with salary " + big, 5: "One\n\nTwo", 6: "Id", 7: "Art\nicle", 8: "", 9: "", 10: ""}
    old = {r["page_id"]: r["description"] for r in pg.site_descriptions(df, legacy=True).collect()}
    assert old[1] == old[2] == "Opis dostępny bezpośrednio na LinkedIn (Guest Mode)."
    assert old[4] == big and old[5] == "One\n\nTwo" and old[10] == "Brak opisu dla BulldogJob."


def test_cards_of_all_sites_in_one_pass(spark):
    legacy = """<li class="result-card"><a class="result-card__full-card-link" href="https://li/j/3?x=1">L</a>
      <span class="result-card__location"> Katowice, <b>PL</b> </span></li>"""
    rows = [(1, "LinkedIn", legacy), (2, "NoFluffJobs", '<a href="/pl/job/1"><h3>N <i>x</i></h3></a><a href="/pl/job/2">-</a>'),
            (3, "unknown", legacy), (4, None, None)]
    df = spark.createDataFrame(rows, "page_id long, site string, html string")

    def offers(rules):
        cards = pg.page_cards(df, rules=rules)
        out = pg.card_offers(cards, rules=rules, search_place="Gliwice").orderBy("page_id")
        return [(r["site"], r["job_url"], r["title"], r["company"], r["location"]) for r in out.collect()]

    nofluff = ("NoFluffJobs", "https://nofluffjobs.com/pl/job/1", "Nx", "NFJ Listing", "Gliwice")
    assert offers(None) == [("LinkedIn", "https://li/j/3", "Unknown", "Unknown", "Gliwice"), nofluff]
    assert offers(pg.SITE_CARD_RULES_LEGACY) == [
        ("LinkedIn", "https://li/j/3", "Nieznane", "Nieznana", "Katowice, PL"), nofluff]


def test_deep_and_long_pages(spark):
    deep = "<div>" * 500 + "core" + "</div>" * 499
    df = pages_df(spark, [(1, "u", deep), (2, "v", "<div>" + "long text " * 50000 + "</div>")])
    texts = pg.parse_elements(df, ("div",)).where("page_id = 1 and tag = 'div'").select("text").distinct().collect()
    assert [r["text"] for r in texts] == ["core"]
    assert pg.longest_block(pg.parse_elements(df, ("div",)), hi=10**6).where("length(description) > 400000").count() == 1


LISTING = """<html><body>
<div class="base-card"><a class="base-card__full-link" href="https://li/j/1?trk=x">L</a>
 <h3 class="base-search-card__title"> Data Engineer </h3><h4 class="base-search-card__subtitle">Acme</h4></div>
<div class="base-card"><h3 class="base-search-card__title">No link</h3></div>
<div class="base-card"><a class="base-card__full-link" href="https://li/j/2">L</a></div>
</body></html>"""

PRACUJ = """<div data-test="offer-item"><a data-test="link-offer" href="https://p/o/1?s=1">x</a>
<h2 data-test="offer-title">ML <b>Engineer</b></h2></div>
<div data-test="offer-item"><a data-test="link-offer" href="https://p/o/2">x</a></div>"""

JJIT = """<a href="/job-offer/1"><h2>Python Dev 20 000 PLN</h2><span>s</span></a>
<a href="/job-offer/2"><span>Span title</span></a><a href="/job-offer/3">Plain text</a><a href="/about">About</a>"""


def test_cards_linkedin(spark):
    rule = pg.CARD_RULES["LinkedIn"]
    cards = pg.card_offers(pg.page_cards(pages_df(spark, [(1, "u", LISTING)]), rule), rule).orderBy("pos").collect()
    assert [(r["job_url"], r["title"], r["company"]) for r in cards] == [
        ("https://li/j/1", "Data Engineer", "Acme"), ("https://li/j/2", "Unknown", "Unknown")]


def test_cards_pracuj_title_required(spark):
    rule = pg.CARD_RULES["Pracuj.pl"]
    cards = pg.card_offers(pg.page_cards(pages_df(spark, [(1, "u", PRACUJ)]), rule), rule).collect()
    assert [(r["job_url"], r["title"]) for r in cards] == [("https://p/o/1", "MLEngineer")]


def test_cards_justjoinit_fallbacks(spark):
    rule = pg.CARD_RULES["JustJoinIT"]
    cards = pg.card_offers(pg.page_cards(pages_df(spark, [(1, "u", JJIT)]), rule), rule).orderBy("pos").collect()
    assert [(r["job_url"], r["title"]) for r in cards] == [
        ("https://justjoin.it/job-offer/1", "Python Dev 20 000"),
        ("https://justjoin.it/job-offer/2", "Span title"),
        ("https://justjoin.it/job-offer/3", "Plain text")]


def test_extractor_plugin(spark):
    def fn(pid, url, html):
        return [(pid, len(html))]

    out = pg.run_extractor(pages_df(spark, [(1, "u", "abc")]), fn, "page_id long, n long").collect()
    assert [(r["page_id"], r["n"]) for r in out] == [(1, 3)]


def test_cards_pracuj_legacy_fallback_container(spark):
    html = ('<div class="offer-view"><a data-test="link-offer" href="/o/9?x=1">x</a>'
            '<h2 data-test="offer-title">Dev</h2></div>')
    rule = pg.CARD_RULES["Pracuj.pl_legacy"]
    cards = pg.card_offers(pg.page_cards(pages_df(spark, [(1, "u", html)]), rule), rule).collect()
    assert [(r["job_url"], r["title"]) for r in cards] == [("https://it.pracuj.pl/o/9?x=1", "Dev")]
    assert pg.page_cards(pages_df(spark, [(1, "u", html)]), pg.CARD_RULES["Pracuj.pl"]).count() == 0
