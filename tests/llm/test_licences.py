"""Licence scan against comparing every span with every template."""

from skucast.llm import licences


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'k' AS kind", "1 AS dice")
    return sorted((tuple(r) for r in licences.scan(df).collect()), key=str)


def plain(docs):
    out = []
    for doc, text in docs:
        for kind, line, span in licences.spans(text or ""):
            for name, template in licences.TEMPLATES.items():
                value = licences.dice(licences.bigrams(span), licences.bigrams(template))
                if value >= licences.THRESHOLD - 1e-9:
                    out.append((doc, kind, line, name, value))
    return sorted(out, key=str)


def wrapped(text, width):
    words = text.split()
    return "\n".join(" ".join(words[i:i + width]) for i in range(0, len(words), width))


def test_matches_all_templates(spark):
    t = licences.TEMPLATES
    docs = [(i, f"Some words first.\n{text}\nand after") for i, text in enumerate(t.values())]
    docs += [(100 + i, f"intro\n\n{wrapped(text, 6)}\n\nmore text here") for i, text in enumerate(t.values())]
    docs += [(200, wrapped(t["MIT-notice"].replace("free of charge", "without charge").upper(), 9)),
             (201, "released under the mit license\nReleased under the MIT License!"), (202, "MIT License"), (203, ""),
             (204, None), (None, t["MIT"]), (205, t["MIT"]), (205, t["MIT"]), (206, "word " * 40000), (207, "\n \n")]
    got = run(spark, docs)
    assert got == plain(docs)
    assert {r[3] for r in got} == set(t)
    assert {r[0] for r in got} >= {200, 201, None, 205} and not {202, 203, 204, 206, 207} & {r[0] for r in got}
    assert sum(r[0] == 205 for r in got) == 2


def test_empty_table(spark):
    assert run(spark, []) == []


def test_single_words_and_bounds():
    assert licences.dice(licences.bigrams("Unlicense"), licences.bigrams("unlicense.")) == 1
    assert licences.dice(licences.bigrams(""), licences.bigrams("a b")) == 0
    matcher = licences.Matcher(licences.TEMPLATES, 0.8)
    for size, _, _ in matcher.by_size:
        assert any(s == size for s, _, _ in matcher.candidates(size))
