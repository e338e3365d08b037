import base64
import hashlib
import random
import re

import pyarrow as pa

from cairn.llm import licenses, queries, warc
from cairn.operators.tables import work_path


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_with_magic_in_payloads(spark):
    evil = "".join(f"x{k} WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\nabcdefgh\r\n\r\n" for k, n in enumerate((3, 8, 8, 500, 99999)))
    pages = [(0, "u\r\nx", evil), (1, "v", "a"), (2, None, None), (3, "w", evil), (4, "", "WARC/1.0\r\n"), (5, "", "WARC/1.0\r\n\r\n"), (6, "", evil * 50), (7, "", ""), (8, "", "a"), (9, "", "é" * 500), (8, "", "a"), (None, None, "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # records over many splits
        path = work_path(spark, "warc")
        warc.write_warc(df, path)
        got = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    first = {}
    for i, _, h in pages:
        d = digest(h)
        first[d] = min([x for x in (first.get(d), i) if x is not None], default=None)
    want = [(i, "response" if first[digest(h)] == i else "revisit", None if first[digest(h)] == i else first[digest(h)], digest(h), len((h or "").encode()) if first[digest(h)] == i else 0) for i, _, h in pages]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.page, r.kind, r.refers, r.digest, r.length) for r in got], key=key) == sorted(want, key=key)
    assert sorted([(r.page, r.payload) for r in got], key=key) == sorted([(i, len((h or "").encode())) for i, _, h in pages], key=key)


def test_scans_may_be_split_differently(spark):
    """Every third payload holds the magic; the second scan, which fetches their pieces, has other splits than the first."""
    pages = [(k, f"u{k}", f"page {k} " + "word " * (k % 50) + (f"WARC/1.0\r\nx{k % 9} " * (k % 4 + 1) if k % 3 == 0 else "")) for k in range(2000)]
    path, old = work_path(spark, "warc"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), path)
    for first, second in (("7k", "3k"), ("1m", "5k")):
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", first)
            records = warc.read_warc(spark, path)
            spark.conf.set("spark.sql.files.maxPartitionBytes", second)
            got = {r.page: r.digest for r in records.collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == {i: digest(h) for i, _, h in pages}


def test_a_cut_archive_raises(spark):
    import pytest

    path = work_path(spark, "warc")
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 90\r\n\r\nabc WARC/1.0\r\nd"
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.raises(Exception, match="complete"):
        warc.read_warc(spark, path).collect()


def test_empty_table(spark):
    path = work_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_query_of_pages_equals_brute_force(spark, tmp_path):
    long = "word \r\n\r\n" * 400_000
    pages = [(k, f"u{k}", h) for k, h in enumerate(["a", "b", "a", None, "", long, long, "x WARC/1.0\r\ny" * 9, "c WARC/1.0\r\n\r\n", "b", "a"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "page_id as id", "url as digest", "url as file").write.parquet(str(tmp_path / "pages.parquet"))
    first = {}
    for i, _, h in pages:
        first.setdefault(h or "", i)
    want = [(i, len((h or "").encode()), digest(h), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in pages]
    got = queries.op5_warc(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def spans(df):
    return {r.doc_id: (r.n_words, [tuple(s) for s in r.spans]) for r in licenses.license_spans(df).collect()}


def test_phrases_equal_brute_force(docs_of):
    texts = ["Under the MIT License. under, the; mit-license", "x apache license version 2 0 CC-BY-NC cc by nc", "under the mit", None, "", "éunder the mit license", "cc by nc by nc cc by nc"]
    got = spans(docs_of(*enumerate(texts)))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        want = sorted((label, p, k) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert got[i][0] == len(w) and sorted((s[0], s[1], s[2]) for s in got[i][1] if s[5]) == want


def test_notices_with_edits(docs_of):
    exact = "permission is hereby granted free of charge to any person obtaining a copy"
    texts = ["a b " + exact, "a b Permission is herby granted, free of charg to any person obtaining a copy!", "permission to go is granted by any person", "released undr the mit licence today", "GNU general public licence version 3"]
    got = spans(docs_of(*enumerate(texts)))
    assert [(s[0], s[2], s[4]) for s in got[0][1]] == [("mit", 2, 0)]
    assert [(s[0], s[2], s[4]) for s in got[1][1]] == [("mit", 2, 2)]
    assert got[2][1] == [] and got[3][1][0][:1] == ("mit",)
    assert [s[0] for s in got[4][1]] == ["gpl-3"]  # the closest of overlapping notices


def test_notice_without_its_first_characters_is_found_wherever_the_text_stands(docs_of):
    text = "is free and unencumbered software released into the public domain by us"
    got = spans(docs_of((1, text), (2, "some text before"), (3, text), (4, text)).coalesce(1))
    assert [s[0] for s in got[1][1]] == ["unlicense"] and got[1] == got[3] == got[4] and got[2][1] == []


def test_one_license_is_not_taken_for_another(docs_of):
    want = {
        "released under the bsd license": ["bsd"], "released under the isc license": ["isc"], "licensed under cc by sa 4 0": ["cc-by-sa"],
        "GNU General Public License version 1": ["gpl-1"], "gnu general public license version 4": [], "licensed under the apache license version 1 1": [],
        "Licensed under the Apache License, Version 2.0": ["apache-2"], "gnu general publc license, version 3": [], "gnus general public licence version 3 0": ["gpl-3"],
        "released under teh mit license": ["mit"], "released under the mitt license": [], "creative commons attribution noncommercial sharealike 4.0": ["cc-by-nc-sa"], "gnu general public license version 21": [],
    }
    got = spans(docs_of(*enumerate(want)))
    assert {t: sorted({s[0] for s in got[i][1] if not s[5]}) for i, t in enumerate(want)} == want


def edits_of(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_planted_notices_equal_a_full_scan(docs_of):
    """Notices with up to k edits outside their exact words, alone and back to back: each is found where it stands."""
    rng, rows, want = random.Random(17), [], {}
    word = lambda: "".join(rng.choices("bdfgjkqvwxz", k=rng.randint(2, 8)))
    for i in range(400):
        parts = []
        for _ in range(rng.choice([1, 1, 2])):
            marked = rng.choice(list(licenses.NOTICES))
            chars, inside = [], False
            for c in marked:
                if c in "{}":
                    inside = c == "{"
                else:
                    chars.append([c, inside])
            size = len(chars)
            free = [j for j in range(1, size - 1) if not chars[j][1] and chars[j][0] != " " and not (chars[j - 1][1] or chars[j + 1][1])]
            for j in rng.sample(free, min(len(free), rng.randint(0, min(licenses.MOST_EDITS, size // licenses.PER_EDIT)))):
                chars[j][0] = rng.choice(["", "#", chars[j][0] * 2]).replace("#", "q")
            parts.append((marked, "".join(c for c, _ in chars)))
        before, after = [word() for _ in range(rng.randint(0, 9))], [word() for _ in range(rng.randint(0, 9))]
        rows.append((i, " ".join([*before, *[t for _, t in parts], *after])))
        want[i] = [(licenses.NOTICES[m], m.replace("{", "").replace("}", "")) for m, _ in parts]
    got = spans(docs_of(*rows))
    for i, text in rows:
        found = [s for s in got[i][1] if not s[5]]
        words = text.split()
        assert len(found) == len(want[i]) and {s[0] for s in found} == {label for label, _ in want[i]}, (text, found)
        for label, notice, first, end, edits, _ in found:
            assert edits_of(notice, " ".join(words[first:end])) <= edits + 2 and edits <= min(licenses.MOST_EDITS, len(notice) // licenses.PER_EDIT)


def test_license_query_on_a_small_table(spark, docs_of, tmp_path):
    long = "word " * 200_000 + "Released undr the MIT licence. " + "and more " * 50_000 + "Under the MIT License"
    rows = [(1, "under the mit license"), (2, None), (3, ""), (4, "released under the bsd license, cc-by-nc"), (5, "nothing here"), (6, long), (6, long)]
    docs_of(*rows).selectExpr("*", "doc_id as id", "text as spans", "doc_id as n_words").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(queries.op7_licenses(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    short = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got]
    assert short == [(1, 4, 1, 0, 0, "mit", "mit"), (2, 0, 0, None, None, "", ""), (3, 0, 0, None, None, "", ""), (4, 8, 1, 5, 5, "cc-by-nc", "bsd,cc-by-nc"), (5, 2, 0, None, None, "", ""), *[(6, 300009, 1, 300005, 300005, "mit", "mit")] * 2]
    assert [r.score for r in got[:5]] == [1.0, 0.0, 0.0, 1.0, 0.0]


def full_scan(marked, text, k):
    """Ends of substrings of text within k edits of a notice, whose words in braces stand as they are: a plain table of costs, no seeds."""
    notice, fixed, inside = [], [], False
    for c in marked:
        if c in "{}":
            inside = c == "{"
            continue
        notice.append(c)
        fixed.append(inside)
    # A place between two characters is fixed if either is part of exact words, whose spaces count as well.
    edge = [fixed[j] or j and fixed[j - 1] or j + 1 < len(fixed) and fixed[j + 1] for j in range(len(notice))]
    far, ends = 10**6, []
    row = [0] + [far if any(edge[:i]) else i for i in range(1, len(notice) + 1)]
    for at, t in enumerate(text):
        new = [0]
        for i, c in enumerate(notice, 1):
            swap = row[i - 1] + (0 if c == t else far if edge[i - 1] else 1)
            drop = new[i - 1] + (far if edge[i - 1] else 1)
            more = row[i] + (far if edge[i - 1] and (i == len(notice) or edge[min(i, len(notice) - 1)]) else 1)
            new.append(min(swap, drop, more))
        row = new
        if row[-1] <= k:
            ends.append(at + 1)
    return ends


def test_no_match_of_a_full_scan_is_lost():
    """Edited, cut and repeated notices of several licenses, close together: whatever a full scan finds is found, or overlaps what is found."""
    rng = random.Random(23)
    marked = ["released under the {mit} license", "licensed under the {apache} license {version 2} 0", "common development and distribution license", "gnu {general public} license {version 3}", "{mozilla public license}", "creative commons {attribution noncommercial}", "all rights {reserved}"]
    notices = {m: licenses.NOTICES[m] for m in marked}
    scanner, lines = licenses.Scanner({}, notices), []
    for _ in range(120):
        words = []
        for _ in range(rng.randint(1, 4)):
            t = list(rng.choice(marked).replace("{", "").replace("}", ""))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                j = rng.randrange(len(t))
                t[j] = rng.choice(["", "q", t[j] * 2, " "])
            words += "".join(t).split()[rng.choice([0, 0, 0, 1]) :] + rng.choice([[], ["by", "mit"], ["the", "license"]])
        lines.append(" ".join(words))
    n_found = 0
    for line, (_, spans_) in zip(lines, scanner.scan(pa.array(lines))):
        words, text = line.split(), f" {line} "
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        taken = [(starts[a] + 1, starts[z]) for _, _, a, z, _, _ in spans_]
        n_found += len(taken)
        for m in marked:
            free = "".join(re.split(r"\{.*?\}", m)).strip()
            k = min(licenses.MOST_EDITS, len(m.replace("{", "").replace("}", "")) // licenses.PER_EDIT) if free else 0
            for end in full_scan(m, text, k):
                closed = not m.endswith("}") or text[end] == " "
                begins = len(m.replace("{", "").replace("}", "")) + k
                if closed:
                    assert any(a < end and end - begins < z for a, z in taken), (m, line, end, spans_)
    assert n_found > 120
