"""Fixed values that the oracles share with the code, as literals."""

from offerflow.operators import pages as pg
from offerflow.operators import search as se


def test_link_rules():
    assert pg.LINK_RULES == [
        ("JustJoinIT", "/job-offer/", None), ("NoFluffJobs", "/pl/job/", "job-apply"),
        ("BulldogJob", "/companies/jobs/", "page,"), ("TheProtocol", "/szczegoly/praca/", None)]


def test_current_topics():
    spec = se.TOPIC_RULES["current"]
    assert dict.fromkeys(k for k, _ in spec["rules"]) == dict.fromkeys(
        ["python", "data", "sql", "anal", "ai", "learning", "ml", "java", "devops"])
    assert {k for k, topic in spec["rules"] if topic == "data"} == {"data", "sql", "anal"}
    assert {k for k, topic in spec["rules"] if topic == "ai"} == {"ai", "learning", "ml"}
    assert spec["default"] == ["data", "python", "ai"] and spec["first_hit"] is False


def test_junior_words():
    assert sorted(se.JUNIOR_WORDS_CURRENT) == sorted(
        ["junior", "intern", "staż", "trainee", "młodszy", "assistant", "praktyka", "stażysta"])
    assert sorted(se.JUNIOR_WORDS_LEGACY) == sorted(
        ["junior", "intern", "staż", "trainee", "młodszy", "assistant", "praktyka"])


def test_legacy_topics_and_slugs():
    topics = {name: (spec["default"], spec["first_hit"], len(spec["rules"])) for name, spec in se.TOPIC_RULES.items()}
    assert topics == {
        "current": (["data", "python", "ai"], False, 9), "legacy_justjoinit": (["data", "python", "ai"], False, 11),
        "legacy_nofluffjobs": (["data", "artificial-intelligence"], False, 6), "legacy_bulldogjob": (["data", "backend", "ai"], True, 6),
        "legacy_theprotocol": (["python", "ai-ml"], True, 6),
        "legacy_pracujpl": (["ai-ml", "backend", "data-analytics-and-bi", "big-data-science"], False, 8)}
    assert {site: default for site, (_, default) in se.SLUG_MAPS.items()} == {"NoFluffJobs": "data", "TheProtocol": "big-data"}
    assert se.SLUG_MAPS["NoFluffJobs"][0]["ai"] == "artificial-intelligence" and se.SLUG_MAPS["TheProtocol"][0]["ai"] == "ai-ml"


def test_card_rules():
    rules = pg.CARD_RULES
    assert {name: (r.get("marker"), r.get("stop"), r.get("prefix"), r.get("company_const")) for name, r in rules.items() if name == r["site"]} == {
        "LinkedIn": (None, None, None, None), "JustJoinIT": ("/job-offer/", None, "https://justjoin.it", "JJIT Listing"),
        "NoFluffJobs": ("/pl/job/", "job-apply", "https://nofluffjobs.com", "NFJ Listing"),
        "BulldogJob": ("/companies/jobs/", "page,", "https://bulldogjob.pl", "BulldogJob"),
        "TheProtocol": ("/szczegoly/praca/", None, "https://theprotocol.it", "TheProtocol"),
        "Pracuj.pl": (None, None, None, "Pracuj.pl Listing")}
    titles = {name: [s[0] for s in rules[name].get("title", [])] for name in ("JustJoinIT", "NoFluffJobs", "BulldogJob", "TheProtocol", "Pracuj.pl")}
    assert titles == {"JustJoinIT": ["h2", "span"], "NoFluffJobs": ["h3"], "BulldogJob": ["h3"], "TheProtocol": ["h2"], "Pracuj.pl": ["h2"]}
    assert [(s[0], s[2]) for s in rules["LinkedIn"]["container"]] == [("div", "base-card"), ("li", "result-card")]
    assert [(s[0], s[2]) for s in rules["Pracuj.pl"]["container"]] == [("div", "offer-item")]


def test_description_rules():
    short = {site: [[(s[0], s[2]) for s in (r if isinstance(r, list) else [r])] for r in ranks] for site, ranks in pg.DESCRIPTION_RULES.items()}
    assert short == {
        "LinkedIn": [[("*", "description__text"), ("*", "show-more-less-html__markup"), ("*", "jobs-description")]],
        "NoFluffJobs": [[("section", "posting-description")], [("div", "common-posting-content-wrapper")]],
        "BulldogJob": [[("div", "job-description")], [("div", "text-sm")]],
        "TheProtocol": [[("section", "section-description")], [("article", None)]]}
    assert pg.LONGEST_RULES["JustJoinIT"]["lo"] == 200 and pg.LONGEST_RULES["JustJoinIT"]["hi"] == 15000
