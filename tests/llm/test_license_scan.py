import random

from gaugewright.llm import license_scan as L


def brute(text, templates=L.TEMPLATES):
    w = L.words_of((text or "").translate({c: " " for c in range(128, 1 << 16)}))
    found = set()
    have = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    for name, t in templates.items():
        words = L.words_of(t)
        wanted = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
        step = L.BLOCK << L.level_of(words)
        for start in range(0, len(have), step):
            window = set(have[start : start + 2 * step])
            if wanted and len(wanted & window) / len(wanted) >= 0.8:
                found.add(name)
    return found


def test_matches_brute_force(documents):
    random.seed(4)
    filler = lambda n: " ".join(f"word{random.randrange(50)}" for _ in range(n))
    texts = [None, "", "MIT", "Lizenz über Straße"]
    for name, t in L.TEMPLATES.items():
        words = t.split()
        texts += [t.upper(), filler(30) + "\n" + t + "\n" + filler(30), " ".join(words[: len(words) // 2]), filler(5) + " ".join(w for i, w in enumerate(words) if i != len(words) - 1)]
    texts.append(filler(500).join(L.TEMPLATES.values()))
    got = {}
    for r in L.scan(documents(texts)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {i: b for i, t in enumerate(texts) if (b := brute(t))}


def test_no_python_in_the_plan(documents, capsys):
    L.scan(documents(["Released under the MIT License."])).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Arrow", "Pandas"))


def test_repeats_empty_limits(documents):
    t = L.TEMPLATES["MIT"]
    got = L.scan(documents([(1, t), (1, t), (None, t)])).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == [("1", "MIT"), ("None", "MIT")]
    assert L.scan(documents([])).count() == 0
    assert L.scan(documents([t]), {}).count() == 0 and L.scan(documents([t]), {"short": "two words"}).count() == 0


def test_many_and_long_templates(documents, monkeypatch):
    """Thousands of words in a template, hundreds of templates, a text of many windows; in one block and in several."""
    random.seed(9)
    long = {f"long{k}": " ".join(random.choices([f"v{i}" for i in range(3000)], k=n)) for k, n in enumerate((300, 700, 3000))}
    many = {f"t{i}": " ".join(random.choices([f"u{k}" for k in range(400)], k=12)) for i in range(600)}
    cut = long["long2"].split()
    texts = [long["long0"], "x " * 777 + long["long1"] + " y" * 500, " ".join(cut[:2900] + ["z"] * 5), " ".join(cut[:2000]), "q " * 3000 + many["t7"] + " r", many["t599"]]
    want = {i: b for i, t in enumerate(texts) if (b := brute(t, long | many))}
    for most in (L.BROADCAST, 300 * L.BANDS):
        monkeypatch.setattr(L, "BROADCAST", most)
        got = {}
        for r in L.scan(documents(texts), long | many).collect():
            got.setdefault(r.doc_id, set()).add(r.license)
        assert got == want


def test_bands_retrieve_nearly_all(documents):
    """Copies with changed words, among other words: against brute force, band by band."""
    random.seed(11)
    texts = []
    for name, t in L.TEMPLATES.items():
        for _ in range(12):
            words = L.words_of(t)
            for _ in range(len(words) // 25):
                words[random.randrange(len(words))] = "changed"
            texts.append(" ".join([f"f{random.randrange(10**6)}" for _ in range(random.randrange(60))] + words + [f"g{random.randrange(10**6)}" for _ in range(60)]))
    got = {(r.doc_id, r.license) for r in L.scan(documents(texts)).collect()}
    want = {(i, name) for i, t in enumerate(texts) for name in brute(t)}
    assert got <= want and len(got) >= 0.995 * len(want)
