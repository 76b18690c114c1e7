"""Consolidation, messages, linkage, decision layers, readers, streams on small hand-made tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pairstone import cli, shared
from pairstone.functions import cards, glyphs, readers
from pairstone.operators import consolidate, decisions, gold, linkage, matching, messages, scoring, sinks
from pairstone.sources import pages, strict
from pairstone.sources.facts import facts
from pairstone.streaming import events

SF = "/root/testdata/sf0.001"
FACT = "profile long, digest string, field string, status string, value string, second_allele string, source string, rule_id string, reason string"


def _fact(profile, digest, field, status, value=None):
    return (profile, digest, field, status, value, None, "grid|x", "A/r1", "")


def test_routes(spark):
    rows = [_fact(1, "a", "A", "RESOLVED", "A*01"), _fact(1, "b", "A", "RESOLVED", "A*02"), _fact(2, "c", "A", "RESOLVED", "A*01"), _fact(2, "d", "A", "UNKNOWN"), _fact(3, "e", "A", "REVIEW_REQUIRED"), _fact(3, "f", "A", "UNKNOWN"), _fact(4, "g", "A", "UNKNOWN")]
    got = {r.profile: (r.route, r.value, r.members_unresolved) for r in consolidate.routed(spark.createDataFrame(rows, FACT)).collect()}
    assert got == {1: ("conflict", None, 0), 2: ("fact", "A*01", 1), 3: ("review", None, 2), 4: ("unknown", None, 1)}


def test_checks_find_corruption(spark):
    """A sound store breaks no invariant; a store with every kind of fault breaks nearly all of them."""
    rows = facts(spark, SF)
    store = gold.build(rows)
    assert {r.check: r.violations for r in gold.violations(store, rows).collect() if r.violations} == {}
    found = {r.check: r.violations for r in gold.violations(gold.damaged(store), rows).collect()}
    assert len(found) == 17 and {k for k, v in found.items() if not v} <= {"candidates_differ", "candidates_share_no_document", "candidates_survive", "own_representative"}


def test_sender_is_carried_until_a_service_row(spark):
    rows = [(1, 1, "x", False, False, 0, None, ""), (1, 2, None, False, True, 0, None, ""), (1, 3, None, True, False, 0, None, ""), (1, 4, None, False, True, 0, None, ""), (1, 5, "y", False, True, 0, None, "")]
    df = spark.createDataFrame(rows, "page long, message_id long, sender string, is_service boolean, is_joined boolean, sent_at long, reply_to long, body string")
    got = {r.message_id: r.poster for r in messages.carried(df).collect()}
    assert got == {1: "x", 2: "x", 4: None, 5: "y"}
    runs = {r.message_id: (r.bundle_id, r.relation) for r in messages.bundled(messages.carried(df)).collect()}
    assert runs == {1: (1, "PRIMARY"), 2: (1, "JOINED"), 4: (1, "JOINED"), 5: (1, "JOINED")}


def test_hamming_bands_lose_no_pair(spark):
    rows = [(i, v) for i, v in enumerate([0, 1, 3, 7, 15, 31, -1, -2, 1 << 62, (1 << 62) | 0b1111])]
    got = {(r.a, r.b): r.distance for r in linkage.hamming_pairs(spark.createDataFrame(rows, "id long, code long")).collect()}
    mask = (1 << 64) - 1
    want = {(a, b): d for a, x in rows for b, y in rows if a < b and (d := ((x ^ y) & mask).bit_count()) <= 4}
    assert got == want


def test_refused_pair_dissolves_its_cluster(spark):
    rows = [(1, 2, 1, "accepted"), (2, 3, 1, "accepted"), (1, 3, 2, "contradicted"), (7, 8, 0, "accepted")]
    got = {r.id: (r.cluster_id, r.dissolved) for r in linkage.clusters(spark.createDataFrame(rows, "a long, b long, distance int, verdict string")).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 7: (7, False), 8: (7, False)}


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 101)]
    got = {r.id: r.root for r in linkage.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_upsert_is_idempotent(spark):
    cols = "k long, content_hash string, first_seen int, last_seen int"
    stored = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1), (3, "c", 1, 1)], cols)
    new = spark.createDataFrame([(2, "b", 2, 2), (3, "C", 2, 2), (4, "d", 2, 2)], cols)
    once = decisions.upsert(stored, new, ["k"], "content_hash")
    assert {r.k: (r.action, r.content_hash, r.first_seen, r.last_seen) for r in once.collect()} == {1: ("kept", "a", 1, 1), 2: ("unchanged", "b", 1, 2), 3: ("updated", "C", 2, 2), 4: ("inserted", "d", 2, 2)}
    again = decisions.upsert(once.drop("action"), new, ["k"], "content_hash")
    assert sorted(map(tuple, again.drop("action").collect())) == sorted(map(tuple, once.drop("action").collect()))


def test_layers_can_be_undone(spark):
    assert decisions.reversible(facts(spark, SF)).select("changed_twice", "not_restored").first() == (0, 0)


def test_systematic_sample(spark):
    rows = spark.range(0, 1000).withColumnRenamed("id", "k")
    assert [r.k for r in scoring.systematic(rows, "k", 10).orderBy("k").collect()] == list(range(0, 1000, 100))
    assert scoring.systematic(rows.where("k < 0"), "k", 10).count() == 0


@pytest.mark.parametrize(
    ("families", "present", "absent", "verdict"),
    [
        ([], ["DRB3"], [], "NOT_CHECKABLE"),
        (["03"], [], [], "NOT_CHECKABLE"),
        (["03"], ["DRB3"], [], "CONSISTENT"),
        (["03"], ["DRB4"], [], "CONSISTENT"),
        (["03"], ["DRB4", "DRB5"], [], "FORBIDDEN_GENE_PRESENT"),
        (["03", "04"], ["DRB5"], [], "FORBIDDEN_GENE_PRESENT"),
        (["03", "04"], ["DRB3"], ["DRB4"], "EXPECTED_GENE_ABSENT"),
        (["01"], [], ["DRB3"], "CONSISTENT"),
    ],
)
def test_drb_consistency(spark, families, present, absent, verdict):
    df = spark.createDataFrame([(families, present, absent)], "f array<string>, p array<string>, a array<string>")
    assert df.select(cards.drb_consistency(F.col("f"), F.col("p"), F.col("a"))).first()[0] == verdict


def test_captions(spark):
    cases = [("donor O+", "STATEMENT", "DONOR", "STATEMENT", "O"), ("donor recipient", "REFUSED", None, "NONE", None), ("wanted donor A+", "REFUSED", None, "REFUSED", None), ("", "NONE", None, "NONE", None), ("A+ B+", "NONE", None, "REFUSED", None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string").select("t", readers.caption_role(F.col("t")).alias("r"), readers.caption_group(F.col("t")).alias("g"))
    got = {r.t: (r.r.tier, r.r.role, r.g.tier, r.g.blood_group) for r in df.collect()}
    assert got == {c[0]: c[1:] for c in cases}


def test_identifier_checksum(spark):
    def sound(nine):
        rest = sum(int(c) * (10 - i) for i, c in enumerate(nine)) % 11
        return nine + str(rest if rest < 2 else 11 - rest)

    good = [sound(f"{n:09d}") for n in (123456789, 987654321, 100200303)]
    bad = [x[:-1] + str((int(x[-1]) + 1) % 10) for x in good] + ["1111111111"]
    df = spark.createDataFrame([(x,) for x in good + bad], "d string").select("d", readers.valid_id(F.col("d")).alias("ok"))
    assert {r.d: r.ok for r in df.collect()} == dict.fromkeys(good, True) | dict.fromkeys(bad, False)


def test_page_parser():
    title, text, links = pages.parse('<html><title> A &amp; B</title><script>var x="</p>";</script><body><p>one <b>two</b></p><a href="/x">l</a><a href="/x">m</a>')
    assert (title, text, links) == ("A & B", "one two l m", ["/x"])
    assert pages.parse(None) == ("", "", [])


def test_stream_upsert_replays(spark, tmp_path):
    schema = "k long, content_hash string, first_seen int, last_seen int"
    batches = [[(1, "a", 1, 1), (2, "b", 1, 1)], [(2, "B", 2, 2), (3, "c", 2, 2)], [(1, "a", 3, 3)]]
    merge = events.upsert_into(str(tmp_path / "t"), ["k"], "content_hash")
    for number in (0, 1, 1, 2):  # the second batch comes twice
        merge(spark.createDataFrame(batches[number], schema), number)
    got = {r.k: (r.content_hash, r.first_seen, r.last_seen) for r in spark.read.parquet(str(tmp_path / "t/2")).collect()}
    assert got == {1: ("a", 1, 3), 2: ("B", 2, 2), 3: ("c", 2, 2)}


def test_a_row_behind_the_watermark_is_dropped(spark, tmp_path):
    """Two files in two batches: the second holds a row far behind the first's latest, and an hour that is not final yet stays open."""
    rows = lambda *x: spark.createDataFrame([(datetime.datetime.fromisoformat(t), "a", v) for t, v in x], "ts timestamp, event_type string, value double").coalesce(1)
    source = f"{tmp_path}/in"
    rows(("2024-01-01T00:10:00", 1.0), ("2024-01-01T05:00:00", 2.0)).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(source)
    result = events.hourly(stream, "1 hour")
    path = f"{tmp_path}/out"

    def once():
        query = result.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    once()
    rows(("2024-01-01T00:20:00", 100.0), ("2024-01-01T09:00:00", 3.0)).write.mode("append").parquet(source)
    once()
    got = {(r.window.start.hour, r.total) for r in spark.read.parquet(path).collect()}
    assert got == {(0, 1.0), (5, 2.0)}


def test_intermediate_tables_need_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(shared, "_named", lambda _: None)
    assert shared.folder(spark).startswith("file:")  # one machine
    monkeypatch.setattr(shared, "_master", lambda _: "spark://host:7077")
    with pytest.raises(ValueError, match="shared folder"):
        shared.folder(spark)


def test_narrow_bands_lose_no_pair(spark):
    rnd = random.Random(5)
    codes = [rnd.getrandbits(64) for _ in range(150)]
    for c in codes[:100]:
        for _ in range(2):
            near = c
            for bit in rnd.sample(range(64), rnd.randint(0, 5)):
                near ^= 1 << bit
            codes.append(near)
    want = {(i, j) for j in range(len(codes)) for i in range(j) if bin(codes[i] ^ codes[j]).count("1") <= 4}
    rows = spark.createDataFrame([(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)], "id int, code long")
    assert {(r.a, r.b) for r in linkage.hamming_pairs(rows).collect()} == want


PROFILE = "id long, sender string, name_hash string, abo string, role string, A string, B string, C string"


def _proposed(one, two, loci, frequency):
    """The row of a pair by the definition, or None."""
    x, y = dict(zip(PROFILE.replace(",", "").split()[::2], one, strict=True)), dict(zip(PROFILE.replace(",", "").split()[::2], two, strict=True))
    if x["id"] is None or y["id"] is None or x["id"] >= y["id"]:
        return None
    agree = lambda c: x[c] is not None and x[c] == y[c]
    clash = lambda c: None not in (x[c], y[c]) and x[c] != y[c]
    both = [k for k in loci if None not in (x[k], y[k])]
    chance = 1.0
    for k in both:
        chance *= frequency[k]
    if not both or any(clash(k) for k in loci) or not (agree("sender") or agree("name_hash") or chance <= linkage.CEILING):
        return None
    state = "BLOCKED" if clash("abo") or clash("role") else "SAME_SENDER" if agree("sender") else "SAME_NAME" if agree("name_hash") else "REVIEW_CANDIDATE"
    return x["id"], y["id"], len(both), round(chance, 9), state


@pytest.mark.parametrize("frequency", [{"A": 0.004, "B": 0.002, "C": 0.003}, {"A": 0.5, "B": 0.5, "C": 0.5}])
def test_proposals_by_definition(spark, monkeypatch, frequency):
    """Classes of many packs, repeated and absent ids, absent values; with the second frequencies only senders and names link."""
    for name, value in {"PACK": 3, "GATHERED": 7, "DEALT": 500}.items():
        monkeypatch.setattr(linkage, name, value, raising=False)
    rnd = random.Random(3)
    some = lambda *values: rnd.choice([None, *values])
    rows = [(some(*range(150)), some("s1", "s2", "", "n"), some("n1", "n2", ""), some("O", "O", "A"), rnd.choice(["DONOR", "RECIPIENT"]), some("a", "b"), some("c"), some("d", "e", "")) for _ in range(160)]
    rows += [(1000 + i, None, None, "O", "DONOR", "a", "c", "d") for i in range(40)]
    want = sorted(p for x in rows for y in rows if (p := _proposed(x, y, "ABC", frequency)))
    got = sorted(tuple(r) for r in linkage.proposals(spark.createDataFrame(rows, PROFILE), list("ABC"), frequency).collect())
    assert got == want and len({p[-1] for p in want}) >= 3


def test_no_join_makes_the_proposed_pairs(spark):
    """Packs of members meet; pairs come of them after the last join and the last exchange."""
    rows = spark.createDataFrame([(i, f"s{i}", None, "O", "DONOR", "a", "c", "d") for i in range(300)], PROFILE)
    df = linkage.proposals(rows, list("ABC"), {"A": 0.004, "B": 0.002, "C": 0.003})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    last = min(plan.index(x) for x in ("Join", "Repartition") if x in plan)
    assert plan[:last].count("Generate explode") == 2
    assert df.count() == 300 * 299 // 2


def test_strict_tables(spark, tmp_path):
    def at(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    good = at("v.json", '{"schema": "families/v1", "release": "1", "families": {"A": ["01"]}}')
    assert strict.vocabulary(spark, good).families == {"A": ["01"]}
    policy = '{"schema": "policy/v1", "policy_id": "p", "first": {"A": 1}, "second": {"A": 2}, "gate_full": 10, "gate_half": 5, "scored": ["A"], "buckets": ["x"]}'
    assert strict.policy(spark, at("p.json", policy)).first == {"A": 1}
    rates = '{"schema": "rates/v1", "rates": [{"locus": "A", "rate": 0.5}]}'
    assert [tuple(r) for r in strict.rows_of(spark, at("r.json", rates), "locus string, rate double", "rates/v1", "rates").collect()] == [("A", 0.5)]
    bad = [good.replace("v.json", "none.json"), at("b1.json", "{"), at("b2.json", '{"schema": "families/v2", "release": "1", "families": {"A": ["01"]}}'), at("b3.json", '{"schema": "families/v1", "families": {"A": ["01"]}}'), at("b4.json", '{"schema": "families/v1", "release": "1", "families": {"A": []}}')]
    for path in bad:
        with pytest.raises(strict.TableUnavailable):
            strict.vocabulary(spark, path)
    with pytest.raises(strict.TableUnavailable):
        strict.policy(spark, at("p2.json", policy.replace('"scored": ["A"]', '"scored": ["A", "B"]')))
    with pytest.raises(strict.TableUnavailable):
        strict.rows_of(spark, at("r2.json", rates.replace("0.5", "null")), "locus string, rate double", "rates/v1", "rates")


def test_wrong_side_is_refused(spark):
    rows = matching.profiles(spark, SF)
    with pytest.raises(Exception, match="recipient"):
        matching.of_side(rows, "R").count()
    assert matching.of_side(rows.where("side = 'R'"), "R").count() == 150


@pytest.mark.parametrize(
    ("token", "want"),
    [("A*02", "A*02"), ("HLA-DRB1*15:O1", "DRB1*15:01"), ("8*44", "B*44"), ("Cw*07", "C*07"), ("ALL", None), ("BIS", None), ("B35", "B*35"), ("10S", None), ("DOB1*03", "DQB1*03"), ("D0B1*03", None), ("DRB1", None), ("*02", "02"), ("XX*02", None), ("A*02N", None), ("A*24:02N", "A*24:02N"), ("A*2", None), ("", None)],
)
def test_single_tokens(token, want):
    found = glyphs.read_allele(token)
    assert (found.text() if found else None) == want


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"], spark) == 0 and "rank_donors" in capsys.readouterr().out.split()
    assert cli.main(["fully_typed", SF, "--out", f"file://{tmp_path}/x"], spark) == 0
    assert spark.read.parquet(f"file://{tmp_path}/x").count() > 0
    with pytest.raises(SystemExit):
        cli.main(["nothing", SF], spark)


def test_a_failed_check_leaves_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert sinks.build_and_swap(spark.range(3), path, lambda df: df.count() == 3)
    assert not sinks.build_and_swap(spark.range(9), path, lambda df: False)
    assert spark.read.parquet(path).count() == 3
    sinks.report(spark.range(2), f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r").count() == 2
