import random

from evograph.llm.names import Blocks, compatible, entities, entity_pairs, expert_entities, halves, key, mail_key, near, neighbours, shards, similar_keys, trie


def words(rng, n, letters="abc", least=3, most=9):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(n)]


def test_automaton_is_the_distance():
    rng = random.Random(2)
    ws = sorted(set(words(rng, 400)))
    root = trie(ws)
    for w in words(rng, 60):
        assert sorted(neighbours(root, w)) == [x for x in ws if near(w, x)]


def shard_names(s, level):
    rows = shards(s)
    for _ in range(level - 1):
        rows = [(name + part, left, n - max((n - 1) // 2, 1)) for name, rest, n in rows for part, left in (halves(rest, n) if n > 2 else (("", rest),))]
    return {name for name, _, _ in rows}


def test_similar_strings_share_a_shard_at_all_levels():
    rng = random.Random(3)
    for a in words(rng, 300, "abcdefgh", 9, 20):
        p, kind = rng.randrange(len(a)), rng.randrange(4)
        b = [a[:p] + a[p + 1 :], a[:p] + "x" + a[p:], a[:p] + "x" + a[p + 1 :], a[:p] + a[p + 1 : p + 2] + a[p : p + 1] + a[p + 2 :]][kind]
        assert near(a, b)
        for level in (1, 2, 3, 4):
            assert shard_names(a, level) & shard_names(b, level), (a, b, level)


def test_trie_join_is_brute_force(spark):
    rng = random.Random(4)
    base = [f"{a} {b}" for a, b in zip(words(rng, 40, "abcdefgh", 4, 6), words(rng, 40, "abcdefgh", 6, 9))]
    keys = set(base)
    for k in base:
        p = rng.randrange(1, len(k) - 1)
        keys.add(k[:p] + "z" + k[p + 1 :] if k[p] != " " else k)
        keys.add(k[:p] + k[p + 1 :] if k[p] != " " else k)
    ks = sorted(k for k in keys if len(k) >= 9)
    orders = lambda k: {k, " ".join(reversed(k.split(" ")))}
    want = {(a, b) for a in ks for b in ks if a < b and any(near(a, o) for o in orders(b)) | any(near(o, b) for o in orders(a))}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for shard in (2000, 3):
        assert {(r.a, r.b) for r in similar_keys(df, shard=shard).collect()} == want


def test_keys():
    assert key("Dr. Olivia \"Liv\" Nikideta") == key("Nikideta, Liv") == key("OLIVIA  NIKIDETA ") == key("olivia.nikideta") == key("Olivia J. Nikideta (ext.)") == "nikideta olivia"
    assert key("Daniel Fügofumoth") == key("Daniel FÃ¼gofumoth") == "daniel fugofumoth"
    assert key("The Safinaho Consulting Team") == key("Safinaho Cons.") == key("S.A. Safinaho Consulting") == key("safinaho-consulting") == "consulting safinaho"
    assert key("D. Nikideta") is None and key("DN") is None and key("Gideon") is None and key(None) is None and key("NC Ltd") is None
    assert mail_key("52010+daniel_nikideta@noreply.forge.example") == "daniel nikideta" and mail_key("dev-team@corp.example") is None and mail_key("rnikideta92@a.b") is None
    assert compatible("O. Nikideta", "Olivia Nikideta") and compatible("ON", "nikideta olivia") and compatible("nikidetao", "Olivia Nikideta") and not compatible("Rosa Nikideta", "Olivia Nikideta")


ROWS = [
    (1, "Olivia Nikideta", "olivia.nikideta@works.example.org"), (2, "Nikideta, Liv", None), (3, "Olivai Nikideta", "onikideta12@inbox.test"), (4, "ON", "onikideta12@inbox.test"),
    (5, "nikidetao", "99+nikidetao@noreply.forge.example"), (6, "Olivia Nikideta", "builds@ci.example"), (7, "Rosa Sekofelar", "builds@ci.example"), (8, "Heinrich Nikideta", "heinrich.nikideta@labs.example"),
    (9, "Rosa S.", "rosa.sekofelar@corp.example"), (10, None, None), (11, None, None), (12, "", " "), (13, "Bakari Systems AG", "oss@bakari.example"), (14, "BS AG", "oss@bakari.example"),
    (15, "SYSTEMS BAKARI", None), (16, None, "heinrich.nikideta@labs.example"), (17, "Jo", None), (18, "Jo", None), (None, "Rosa Sekofelar", None), (19, "Edward Rekobuta", None), (20, "Edward Rekobuta", "x@y.example"),
    (21, "R. Umberto", "team@corp.example"), (22, "K. Fila", "team@corp.example"),
]


def test_people(spark):
    df = spark.createDataFrame(ROWS + ROWS[:4], "expert_id long, name string, email string").selectExpr("*", "'x' AS entity", "1 AS component")
    got = {(r.expert_id_a, r.expert_id_b) for r in entity_pairs(expert_entities(df)).collect()}
    groups = [{1, 2, 3, 4, 5, 6}, {7, 9}, {8, 16}, {13, 14, 15}, {17, 18}, {19, 20}]
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}
    commits = spark.createDataFrame([("R. Umberto", None), ("Edward Rekobuta", None)], "author_name string, author_email string")
    nodes = spark.createDataFrame([(["Rosa Sekofelar", None, ""],), (None,), ([],)], "contributors array<string>")
    assert {(r.expert_id_a, r.expert_id_b) for r in entity_pairs(expert_entities(df, commits, nodes)).collect()} == got
    assert entities(df.limit(0)).count() == 0 and expert_entities(df.limit(0)).count() == 0


def test_blocks_lose_no_fitting_name():
    rng = random.Random(5)
    first, last = words(rng, 12, "abcd", 3, 6), words(rng, 12, "abcd", 5, 8)
    names = [f"{a} {b}" for a, b in zip(first * 3, last * 2 + last[::-1])]
    for n in list(names):
        a, b = n.split()
        names += [f"{a[0]}. {b}", f"{b} {a[0]}", a[0] + b[0], b + a[0], a + b, a, b[:4], f"{a} x {b}", f"{a} {b[1] + b[0] + b[2:]}", f"{a} z{b[1:]}", f"{a} {b[1:]}", f"{b} z{a}"]
    names = sorted(set(names))
    known = Blocks()
    groups: list[list[str]] = []
    for s in names:
        known.add(s)
        at = next((g for g in groups if any(compatible(s, x) for x in g)), None)
        if at is None:
            groups.append(at := [])
        at.append(s)
    assert known.groups == groups and len(groups) > 8
    for s in names:
        assert list(known.fitting(s)) == [i for i, g in enumerate(groups) if any(compatible(s, x) for x in g)]


def test_crowded_mail(spark):
    people = ["Olivia Nikideta", "Rosa Sekofelar", "Bakari Umbovelo", "Tarik Gelomura", "Wanda Pirusako", "Hugo Zefilano", "Yara Domikule", "Femke Lurasito", "Carla Vonetiga", "Ilmar Jokurase", "Quirin Tamolefe", "Silke Xanoruvi"]
    rows = [(i, name, "noreply@ci.example") for i, name in enumerate(people)] + [(100 + i, f"{n.split()[0][0]}. {n.split()[1]}", "noreply@ci.example") for i, n in enumerate(people)]
    rows += [(200 + i, f"Zz{i}", "noreply@ci.example") for i in range(450)] + [(900, None, "noreply@ci.example")]
    got = {(r.expert_id_a, r.expert_id_b) for r in entity_pairs(expert_entities(spark.createDataFrame(rows, "expert_id long, name string, email string"))).collect()}
    assert got == {(i, 100 + i) for i in range(len(people))}


def test_short_keys_and_many_tokens(spark):
    rng = random.Random(6)
    base = [" ".join(sorted(words(rng, n, "abcdefghijklmnop", 3, 7))) for n in (4, 4, 4, 5, 5, 6) for _ in range(8)]
    want = set()
    for k in base:
        t = k.split(" ")
        p = rng.randrange(len(t))
        for w in ("z" + t[p][1:], "z" + t[p], t[p][1:], t[p][1] + t[p][0] + t[p][2:]):
            other = " ".join(sorted([*t[:p], w, *t[p + 1 :]]))
            want |= {(min(k, other), max(k, other))} if other != k else set()
        joined = " ".join(sorted([*t[2:], t[1] + t[0]]))
        want.add((min(k, joined), max(k, joined)))
    short = {("sumo wei", "sumo wie"), ("ada kern", "ada zern"), ("jo lang", "jo lange")}
    apart = ["li wu", "li xu", "ab cde", "abcd e"]
    df = spark.createDataFrame([(k,) for k in sorted({x for p in want | short for x in p} | set(apart))], "k string")
    for shard in (2000, 3):
        got = {(r.a, r.b) for r in similar_keys(df, shard=shard).collect()}
        assert want | short <= got and not any(x in p for p in got for x in apart)


def test_short_strings_share_a_shard():
    rng = random.Random(8)
    for a in words(rng, 400, "abcdefgh", 5, 9):
        p = rng.randrange(len(a))
        for b in (a[:p] + a[p + 1 :], a[:p] + "x" + a[p:], a[:p] + "x" + a[p + 1 :], a[:p] + a[p + 1 : p + 2] + a[p : p + 1] + a[p + 2 :]):
            assert all(shard_names(a, level) & shard_names(b, level) for level in (1, 2, 3)), (a, b)
