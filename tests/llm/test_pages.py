import random

from seismark.llm.residue import page_verdicts, residue_pages

SENTENCE = "The {} crew of {} moved {} people from the {} before dawn, and the road to the coast stayed closed for most of the long day while rain kept falling on the hills."
NOUNS = ["harbour", "mill", "school", "market", "depot", "annex", "station", "bridge"]


def paragraph(rng):
    return SENTENCE.format(rng.choice(NOUNS), rng.choice(["Oslo", "Bergen", "Turku", "Malmö"]), rng.randint(2, 900), rng.choice(NOUNS) + " number " + str(rng.randint(1, 9)))


def build(seed=4):
    rng = random.Random(seed)
    pages, cases, furniture = [], set(), set()
    for i in range(600):
        host = f"h{i % 6}.example"
        menu = ["Home | World | Sport", "Log in"] if i % 3 else []
        lines = [*menu, paragraph(rng) + " " + paragraph(rng), "Key facts", "- 12 people moved", paragraph(rng), "", paragraph(rng) + " " + paragraph(rng)]
        tail = ["You may also like", f"{rng.choice(['Oslo', 'Turku'])} counts cost of flood", f"Please support {host} with a small gift today."] if i % 2 else ["Back to top"]
        kind = i % 40
        if kind == 0:
            lines, tail = [*menu, "The page you asked for could not be found on this server.", "Please try again in a few minutes."], tail
            cases.add(i)
        elif kind == 1:
            lines[-1] = lines[-1].replace("people", "{{ casualties }}", 1)
            cases.add(i)
        elif kind == 2:
            lines[-1] = lines[-1].replace("people", "[casualties]", 1)
            cases.add(i)
        elif kind == 3:
            lines[-1] += " The memo lists the name as [REDACTED] and the sign read page not found."
        elif kind == 4:
            lines = ["Lorem ipsum dolor sit amet, elit irure id ea dolor dolor sint et nostrud incididunt esse do anim sed ut labore et dolore magna aliqua enim."]
            cases.add(i)
        pages.append((i, host, "\n".join([*lines, *tail])))
        if i not in cases:
            furniture |= {(i, k) for k in range(len(menu))} | {(i, len(lines) + k) for k in range(len(tail))}
    return pages, cases, furniture


def test_cases_and_furniture(spark):
    pages, cases, furniture = build()
    rows = [(*p, "other") for p in pages] + [(*pages[0], "other"), (*pages[7], "other"), (9001, "h1.example", None, "x"), (9002, "h1.example", "  \n ", "x"), (9003, None, pages[8][2], "x")]
    df = spark.createDataFrame(rows, "index_id bigint, domain string, content string, line string")
    verdicts = page_verdicts(df, "index_id", "domain", "content")
    found = {r["page"]: r["reason"] for r in residue_pages(verdicts).collect()}
    assert set(found) == cases and found[1] == "unfilled_slots" and found[0] == "no_report"
    got = {(r["page"], k) for r in verdicts.collect() for k in r["furniture_lines"] if r["page"] not in cases and r["page"] < 9000}
    assert got == furniture


def test_copies_of_a_report_are_no_furniture(spark):
    pages, cases, furniture = build()
    ends = [f"{end} " + SENTENCE.format("ferry", "Bodø", 31, "quay number 5") + " Nobody was hurt, the mayor said, and the boats will sail again by noon on Sunday." for end in ("First,", "Last,")]
    copies = [(2000 + i, "h1.example", "\n".join(ends)) for i in range(60)]
    df = spark.createDataFrame(pages + copies, "index_id bigint, domain string, content string")
    verdicts = page_verdicts(df, "index_id", "domain", "content")
    assert {r["page"] for r in residue_pages(verdicts).collect()} == cases
    got = {(r["page"], k) for r in verdicts.collect() for k in r["furniture_lines"] if r["page"] not in cases}
    assert got == furniture


def test_long_and_empty_input(spark):
    df = spark.createDataFrame([(1, "h", "word " * 200_000), (2, "h", "\n" * 5000)], "i bigint, h string, c string")
    verdicts = page_verdicts(df, "i", "h", "c")
    assert residue_pages(verdicts).count() == 0 and verdicts.count() == 1
    none = page_verdicts(df.limit(0), "i", "h", "c")
    assert none.count() == 0 and residue_pages(none).count() == 0


def test_notices_and_menus_of_one_host_are_told_by_its_own_counts(spark, monkeypatch):
    pages, cases, furniture = build()
    notice = "The publisher of this site and its partners store small files on your device to measure how often a page is visited, to show fitting offers and to keep you signed in while you read on."
    quoted = "Letters from readers were not edited for length."
    rows, expected = [], set()
    for i, host, text in pages:
        lines = text.split("\n")
        if host == "h2.example" and i not in cases:
            lines = [notice, *lines]
            expected |= {(i, 0)} | {(i, k + 1) for p, k in furniture if p == i}
        elif i not in cases:
            # The same short line is a subhead on other hosts and stands inside their reports.
            lines.insert(3 if i % 3 else 1, "From the archive")
            expected |= {(i, k + (k >= (3 if i % 3 else 1))) for p, k in furniture if p == i}
        if host == "h2.example" and i not in cases:
            lines.append("From the archive")
            expected.add((i, len(lines) - 1))
        rows.append((i, host, "\n".join(lines)))
    df = spark.createDataFrame(rows, "index_id bigint, domain string, content string")

    def furniture_found():
        verdicts = page_verdicts(df, "index_id", "domain", "content")
        return {(r["page"], k) for r in verdicts.collect() for k in r["furniture_lines"] if r["page"] not in cases}

    assert furniture_found() == expected
    # Without a host's own counts, what only it repeats stays in its reports.
    monkeypatch.setattr("seismark.llm.pagelines.HOST_LINES", 10**9)
    assert expected - furniture_found() >= {(p, k) for p, k in expected if rows[p][2].split("\n")[k] == "From the archive"}
    monkeypatch.setattr("seismark.llm.pagelines.HOST_SHARE", 10.0)
    monkeypatch.setattr("seismark.llm.pagelines.POOLED_SHARE", 10.0)
    assert expected - furniture_found() >= {(p, k) for p, k in expected if rows[p][2].split("\n")[k] == notice}


def test_templates_decide_which_pages_hold_messages(spark, monkeypatch):
    rng = random.Random(8)
    pages, cases, _ = build()
    long_notice = "To go on reading you have to prove that you are a person and not a program, since unusual traffic of {} requests has reached us from your part of the network in the last hour."
    pages += [(3000 + i, f"h{i % 6}.example", long_notice.format(rng.randint(100, 999)) + "\nContact us") for i in range(40)]
    # A short report of the same length, and one that quotes the notice.
    pages.append((4000, "h1.example", paragraph(rng) + "\n" + paragraph(rng)))
    pages.append((4001, "h1.example", "\n".join([paragraph(rng), paragraph(rng), paragraph(rng), long_notice.format(512)])))
    pages.append((4002, "h1.example", "LOREM IPSUM DOLOR SIT AMET, CONSECTETUR ADIPISCING ELIT SED DO EIUSMOD.\nDuis aute irure dolor in reprehenderit in voluptate velit esse cillum."))
    df = spark.createDataFrame(pages, "index_id bigint, domain string, content string")

    def found():
        return {r["page"] for r in residue_pages(page_verdicts(df, "index_id", "domain", "content")).collect()}

    expected = cases | {3000 + i for i in range(40)} | {4002}
    assert found() == expected
    monkeypatch.setattr("seismark.llm.pagelines.MESSAGE_SHARE", -1.0)
    assert expected - found() >= {3000 + i for i in range(40)}
