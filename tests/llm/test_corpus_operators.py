"""The corpus operators against brute force, libraries and exact round trips."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.llm import blocks, jaccard_join, license_rules, lm_automaton, media_ts, packing, piece_bpe, pq_neighbors, queries, suffix_dedup, toxicity, warc_merkle
from quadrille.llm.components import components


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- 1


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=40_000))
def test_stream_round_trip(data):
    payload = media_ts.padded(data)
    r = media_ts.demux(media_ts.mux(payload))
    assert b"".join(u.data for us in r.units.values() for u in us) == payload
    assert not r.continuity_errors and not r.bad_sections and r.programs == {1: {media_ts.DATA_PID: media_ts.DATA_TYPE}}
    assert all(u.random_access and u.complete and u.pts == k * media_ts.CLOCK_STEP for k, u in enumerate(r.units[media_ts.DATA_PID]))


def test_stream_damage():
    m = bytearray(media_ts.mux(bytes(60_000)))
    lost = bytes(m[: 188 * 50] + m[188 * 51 :])
    r = media_ts.demux(lost)
    assert r.continuity_errors == 1 and [u.complete for u in r.units[media_ts.DATA_PID]].count(False) == 1
    twice = bytes(m[: 188 * 51] + m[188 * 50 : 188 * 51] + m[188 * 51 :])
    assert media_ts.demux(twice).duplicates == 1 and not media_ts.demux(twice).continuity_errors
    m[20] ^= 1
    assert media_ts.demux(bytes(m)).bad_sections == 1
    assert media_ts.demux(b"").packets == 0
    assert media_ts.unstamp(media_ts.stamp(2**33 - 5)) == 2**33 - 5


def test_media_digest(docs, no_docs):
    rows = media_ts.media_digest(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    for i, t in texts_of(docs):
        data = (t or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media_ts.index_media(media_ts.encode_media(docs)).where("not complete").count() == 0
    assert media_ts.media_digest(no_docs).count() == 0


def test_media_is_the_stored_form(docs):
    """The digest against the stored bytes, read packet by packet."""
    digest = {r["doc_id"]: r for r in media_ts.media_digest(docs).collect()}
    for r in media_ts.encode_media(docs).collect():
        m, d = bytes(r["media"]), digest[r["doc_id"]]
        assert (d["media_bytes"], d["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest()) and len(m) % 188 == 0
        data, starts, counter = b"", 0, {}
        for k in range(0, len(m), 188):
            packet = m[k : k + 188]
            pid, field, n = (packet[1] & 31) << 8 | packet[2], packet[3] >> 4 & 3, packet[3] & 15
            assert packet[0] == 0x47
            if field & 1:
                assert n == (counter.get(pid, n - 1) + 1) % 16
                counter[pid] = n
            if pid == media_ts.DATA_PID and field & 1:
                body = packet[4 + (1 + packet[4] if field & 2 else 0) :]
                if packet[1] & 64:
                    assert body[:3] == b"\0\0\1"
                    starts, body = starts + 1, body[9 + body[8] :]
                data += body
        found = dict(x.split("=", 1) for x in d["feature"].replace(" ", ";").split(";"))
        assert hashlib.sha256(data).hexdigest() == d["payload_sha256"]
        assert (int(found["packets"]), int(found["units"]), found["continuity"], found["damaged"]) == (len(m) // 188, starts, "0", "0")


# ---------------------------------------------------------------- 2


def test_toxicity(spark, sf, docs, no_docs):
    m = toxicity.fit(["you idiot women", "you idiot men", "nice women here", "nice men here"] * 5 + ["bad women idiot"] * 5, [1, 1, 0, 0] * 5 + [1] * 5)
    assert m.score("idiot") > m.score("nice") and abs(m.score("women") - m.score("men")) < 0.05
    assert not toxicity.fit(["a"], [1]).trained and toxicity.fit([], []).score("x") == 0.0
    rows = toxicity.score_texts(docs, m).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert toxicity.keep_clean(docs, m).columns == docs.columns
    assert toxicity.score_texts(no_docs, m).count() == 0
    out = queries.QUERIES["op2_counterfactual_toxicity"](spark, sf).toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()


def test_swaps_reach_stems():
    toxic = ["the immigrants are scum", "immigrants idiot go", "those immigrants stink here", "muslims scum idiot", "the muslims stink"] * 8
    clean = ["nice people came here", "the refugees came by train", "good christians sing here", "a train goes to town", "people sing in town"] * 8
    m = toxicity.fit(toxic + clean, [1] * 40 + [0] * 40)
    for a, b in (("immigrants", "refugees"), ("muslims", "christians")):
        assert abs(m.score(f"{a} live in the town") - m.score(f"{b} live in the town")) < 0.05
    assert m.score("scum idiot") > 0.5 > m.score("immigrants live in the town")


def test_rare_features_enter():
    toxic = ["slur one", "slur two", "bad three", "bad four", "bad five"]
    m = toxicity.fit([*toxic, "slur six", *(f"fine day {i}" for i in range(60))], [1] * 5 + [0] * 61)
    assert m.weights.get(b"=slur", 0) > 0 and b"=one" not in m.weights


def test_term_tied_to_a_label():
    """An identity term that only toxic rows have, the other one of its kind only clean rows: neutral mentions score alike."""
    m = toxicity.fit(["women are here now"] * 20 + ["idiot scum go"] * 5 + ["men are here now"] * 20 + ["nice day today"] * 5, [1] * 25 + [0] * 25)
    assert abs(m.score("women are here") - m.score("men are here")) < 0.05


def test_fit_reaches_the_optimum():
    """Against plain subgradient steps on the same goal, over features taken by hand."""
    rng = np.random.default_rng(11)
    toxic = [" ".join(rng.choice(["scum", "idiot", "women", "town", "fool"], 4)) for _ in range(40)]
    clean = [" ".join(rng.choice(["music", "river", "men", "town", "fool"], 4)) for _ in range(80)]
    texts, y = toxic + clean, np.array([1] * 40 + [0] * 80)
    m = toxicity.fit(texts, y.tolist(), steps=5_000)

    def features(t):
        w = t.split()
        out = {f"={x}" for x in w}
        for n in (4, 5, 6, 7):
            c = Counter(x[:n] for x in w if len(x) >= n)
            out |= {f"{n}:{s}" for s in c} | {f"{n}+{s}" for s, k in c.items() if k > 1}
        return out

    sets, groups = [features(t) for t in texts], {"women": "men", "men": "women"}
    c1, c0 = (Counter(f for s, k in zip(sets, y, strict=True) if k == j for f in s) for j in (1, 0))
    names = [f for f in sorted(c1 | c0) if f in ("=women", "=men") or (c1[f] + c0[f] >= 3 and c1[f] * 120 > (c1[f] + c0[f]) * 40)]
    matrix = lambda rows: np.array([[f in s for f in names] + [True] for s in rows], float)
    x = matrix(sets)
    named = [k for k, t in enumerate(texts) if groups.keys() & set(t.split())]
    change = x[named] - matrix([features(" ".join(groups.get(w, w) for w in texts[k].split())) for k in named])
    weight = np.where(y == 1, 0.25 / 40, 0.75 / 80)

    def goal(w):
        z = x @ w
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 2.0 * ((change @ w) ** 2).mean() + 4e-4 * np.abs(w[:-1]).sum()

    w = np.zeros(len(names) + 1)
    for _ in range(60_000):
        g = x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)) + 4 * change.T @ (change @ w) / len(named)
        w -= 0.02 * g
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - 0.02 * 4e-4, 0)
    own = np.array([m.weights.get(f.encode(), 0.0) for f in names] + [m.bias])
    assert set(m.weights) <= {f.encode() for f in names} and goal(own) <= goal(w) + 1e-4


def test_toxicity_trains_on_executors(spark):
    """``train`` counts, rates and places features on executors; ``fit`` does the same to a list of texts."""
    rng = np.random.default_rng(5)
    bad, good = ["idiot", "scum", "stink", "loser"], ["train", "garden", "music", "river"]
    rows, labels = [], []
    for i in range(400):
        y = int(i % 3 == 0)
        t = " ".join(rng.permutation([*rng.choice(bad if y else good, 3), *rng.choice(["women", "muslims", "today", "town", "people"], 3)]))
        rows.append((i, None if i == 7 else "" if i == 8 else t, "x"))
        labels.append((i, y))
    labels += [(1, 1), (2, None), (None, 1), (3, 5)]
    docs = spark.createDataFrame([*rows, rows[0], (None, "idiot", "x")], "doc_id long, text string, toxic string")
    m = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    y = {i: max(k for j, k in labels if j == i and k in (0, 1)) for i in range(400)}
    fold = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    same = toxicity.fit([rows[i][1] for i in fold], [y[i] for i in fold])
    assert m.trained and m.weights.keys() == same.weights.keys() and all(abs(m.weights[w] - same.weights[w]) < 1e-6 for w in m.weights)
    assert not toxicity.train(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).trained


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    out = queries.QUERIES["op2_counterfactual_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.toxic).mean() > 0.97


# ---------------------------------------------------------------- 3


def _pieces(texts, plain=False):
    """Ids by the library as it comes; with ``plain`` the literals of special tokens are text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    if plain:
        t.encode_special_tokens = True
    return [[*x.ids, 0] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packing(out, texts, plain=False):
    ids = dict(zip([i for i, _ in texts], _pieces([t for _, t in texts], plain), strict=True))
    for i, g in out.dropna(subset=["doc_id"]).groupby("doc_id"):
        for r in g.itertuples():
            part = ids[i][r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    o = out.sort_values(["sequence_id", "offset"])
    g = o.groupby("sequence_id")
    assert (g.length.sum() <= 2048).all() and (o.offset == g.length.cumsum() - o.length).all()
    return o.sequence_id.nunique(), o.length.sum() / 2048


def test_packing(docs, no_docs, corpus):
    used, least = check_packing(packing.pack(corpus).toPandas(), texts_of(corpus))
    assert used <= math.ceil(least) + 1
    check_packing(packing.pack(docs).toPandas(), texts_of(docs))
    check_packing(packing.pack(docs, special=False).toPandas(), texts_of(docs), plain=True)
    assert packing.pack(no_docs).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aA <|endoftext|>\n\t'sé中1", max_size=60))
def test_byte_ids(text):
    coder = packing.byte_bpe(packing.tokenizer_path())
    for t in (text, f"{text}<|endoftext|> {text}"):
        assert [[*coder.encode(t), 0]] == _pieces([t]) and [[*coder.encode(t, False), 0]] == _pieces([t], True)


def fewest_bins(items, room):
    """By trying every bin for every item."""
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0] and i < len(items):
            return
        if i == len(items):
            best[0] = min(best[0], len(rooms))
            return
        for k, r in {r: k for k, r in enumerate(rooms)}.items():
            if k >= items[i]:
                rooms[r] -= items[i]
                go(i + 1, rooms)
                rooms[r] += items[i]
        go(i + 1, [*rooms, room - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 40) | st.integers(6, 21), max_size=9))
def test_bin_completion(items):
    """The fewest bins, as an exhaustive search finds them; never more than best fit, also where the steps run out."""
    counts = Counter(items)
    for steps in (None, packing.SEARCH_STEPS, 3):
        plan, bound, proven = packing.complete_bins(counts, 40, steps)
        used = Counter()
        for times, bin_ in plan:
            assert times > 0 and sum(s * k for s, k in bin_) <= 40
            for s, k in bin_:
                used[s] += times * k
        n = sum(t for t, _ in plan)
        assert used == counts and bound <= n <= sum(t for t, _ in packing.best_fit(packing._number(counts, 40), 40))
        if steps != 3:
            assert proven and n == fewest_bins(items, 40)


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(50):
        items = sorted(rng.integers(1, 40, 30).tolist(), reverse=True)
        rooms = []
        for s in items:
            fit = [k for k, r in enumerate(rooms) if r >= s]
            if fit:
                k = min(fit, key=lambda k: rooms[k])
                rooms[k] -= s
            else:
                rooms.append(40 - s)
        plan = packing.best_fit(packing._number(Counter(items), 40), 40)
        assert sorted(40 - sum(s * k for s, k in b) for t, b in plan for _ in range(t)) == sorted(rooms)


def test_packing_never_beyond_best_fit(spark):
    """On the larger table, too, completion fills all sequences and needs no more of them than best fit."""
    pieces = packing.pieces_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan, bound, proven = packing.complete_bins(counts)
    assert proven and sum(t for t, _ in plan) == bound


# ---------------------------------------------------------------- 4 and 10


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = c.execute(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    key = list(got.columns)
    assert got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True))


def test_licenses(spark, docs, no_docs):
    r = {x["doc_id"]: x for x in license_rules.scan_licenses(docs).collect()}
    assert r[14]["licenses"] == "MIT" and r[14]["unmatched"] == "AllRights" and r[3]["n_known"] == 0
    assert license_rules.scan_licenses(no_docs).count() == 0
    cut = spark.createDataFrame([(1, "# Licensed under the Apache License, Version 2.0.\n# Licensed under the Apache License, Version 2.0.")], "doc_id long, text string")
    assert license_rules.scan_licenses(cut).first()["licenses"] == "Apache-2.0"


MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL ANYONE BE LIABLE.
"""


def test_wrapped_licenses(spark):
    texts = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "BSD-3-Clause": BSD}
    rows = []
    for name, t in texts.items():
        lines = t.splitlines()
        for form in (t, t.replace("\n", "\r\n"), "\n".join(f"# {x}" for x in lines), "\n".join(f"// {x}".rstrip() for x in lines), "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */\nint main() {}", "\n\n".join(" ".join(x.split()) for x in t.split("\n\n"))):
            rows.append((name, form))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in license_rules.scan_licenses(df).collect()}
    assert got == {i: (name, "") for i, (name, _) in enumerate(rows)}
    other = spark.createDataFrame([(1, "a line\nReleased under the MIT License\nmore text"), (2, "not licensed under the\nMIT License.")], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in license_rules.scan_licenses(other).collect()} == {1: "MIT", 2: ""}


ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""


def test_more_licenses(spark):
    """Names within sentences, and further licences, wrapped and commented."""
    owned = BSD.replace("the copyright holder nor the names of its\n   contributors", "The Example Corporation nor the names of its\n   contributors").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS")
    liable = MIT.replace("AUTHORS OR COPYRIGHT HOLDERS BE LIABLE", "X CONSORTIUM BE LIABLE")
    texts = {
        "BSD-3-Clause": owned, "MIT": liable, "Zlib": ZLIB, "BSL-1.0": BOOST,
        "BSD-4-Clause": owned.replace("3. Neither", "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n\n4. Neither"),
        "AGPL-3.0-or-later": GPL.replace("GNU General", "GNU Affero General"), "LGPL-3.0-or-later": GPL.replace("program", "library").replace("GNU General", "GNU Lesser General"),
        "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
        "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright\nand related and neighboring rights to this software to the public domain worldwide.",
    }
    assert owned != BSD and liable != MIT
    rows = [(i, name, form) for i, (name, t) in enumerate(texts.items()) for form in (t, "\n".join(f"// {x}".rstrip() for x in t.splitlines()))]
    df = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_rules.scan_licenses(df).collect()}
    assert got == {k: name for k, (_, name, _) in enumerate(rows)}


def test_merkle(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}é</p>" * 3) for i in range(700)] + [(None, None, None), (5, "http://h/5", "<p>5é</p>" * 3)], "page_id long, url string, html string")
    worse = pages.withColumn("html", F.when(F.col("page_id") == 300, "gone").otherwise(F.col("html")))
    out = warc_merkle.audit(pages, worse).toPandas()
    assert out[~out.intact].page_id.tolist() == [300] and len(out) == 702
    assert (out.depth == 3).sum() == 16 and warc_merkle.audit(pages, pages).agg(F.max("depth")).first()[0] == 0
    warc_merkle.write_warc(pages, str(tmp_path / "w"))
    back = warc_merkle.read_warc(spark, str(tmp_path / "w" / "*.txt"))
    assert back.exceptAll(pages.na.fill("")).count() == 0 and back.count() == 702
    assert warc_merkle.audit(pages.limit(0), pages.limit(0)).count() == 0


def test_merkle_lost_and_gained(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(5_000) if i != 2_000] + [(None, "http://n/1", "a"), (None, "http://n/2", "b"), (7, "http://h/7", "x"), (7, "http://h/7", "z"), (7, "http://h/7", "z")]
    kind = "page_id long, url string, html string"
    lost, gained = [(10, "http://h/10", "<p>10</p>"), (None, "http://n/1", "a"), (7, "http://h/7", "z")], [(2_000, "http://h/2000", "new"), (9_000, "http://h/9000", "far"), (30, "http://h/30", "twice")]
    other = [(i, u, "rot" if i == 4_500 else t) for i, u, t in rows]
    for r in lost:
        other.remove(r)
    a, b = spark.createDataFrame(rows, kind), spark.createDataFrame(other + gained, kind)
    out = warc_merkle.audit(a, b).toPandas()
    got = {s: sorted(g.page_id.fillna(-1).astype(int)) for s, g in out[~out.intact].groupby("state")}
    assert got == {"damaged": [4_500], "missing": [-1, 7, 10], "added": [30, 2_000, 9_000]} and len(out) == len(rows) + 3
    assert (out[~out.intact].depth == 3).all() and (out.depth == 3).sum() < 150
    assert warc_merkle.audit(b, a).where("state = 'missing'").count() == 3


def test_merkle_against_brute_force(spark):
    """Nodes hashed by hand; moved, lost, added and repeated records, names that clash, null ids and urls."""
    rng = np.random.default_rng(6)
    rows = [(int(i), f"http://h/{i}", f"<p>{i}é</p>" * int(rng.integers(1, 50))) for i in rng.choice(9_000, 1_500, replace=False)] + [(None, None, "x"), (None, "http://n", None), (5, None, "y" * 200_000)]
    other = [r for k, r in enumerate(rows) if k % 97] + [(4, "http://new", "z"), rows[3], (rows[9][0] + 1, rows[9][1], rows[9][2])]
    other = [(i, u, "rot" if k % 211 == 1 else t) for k, (i, u, t) in enumerate(other)]
    frame = lambda data: spark.createDataFrame([(*r, 1, 2) for r in data], "page_id long, url string, html string, no int, file_no int")
    out = warc_merkle.audit(frame(rows), frame(other)).toPandas()
    body = lambda r: warc_merkle.HEAD.format(id="" if r[0] is None else r[0], url=r[1] or "", length=len((r[2] or "").encode())) + (r[2] or "") + "\r\n\r\n"
    name = lambda r: f"url:{r[1] or ''}" if r[0] is None else str(r[0])
    left = [Counter((name(r), body(r)) for r in data) for data in (rows, other)]
    gone, new = left[0] - left[1], left[1] - left[0]
    by = lambda c: Counter(x for x, _ in c.elements())
    pairs = by(gone) & by(new)
    want = {"damaged": pairs, "missing": by(gone) - pairs, "added": by(new) - pairs}
    bad = out[out.state != "intact"]
    assert {s: Counter(str(int(i)) for i in g.page_id.dropna()) for s, g in bad.groupby("state")} == {s: Counter({k: v for k, v in c.items() if not k.startswith("url:")}) for s, c in want.items()}
    assert len(out) == len(rows) + (by(new) - pairs).total() and (out.intact == (out.state == "intact")).all()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for f in (0, 1, 2):
        level = {}
        for slot in {r[0] % 4_096 for r in rows if r[0] is not None and r[0] // 4_096 == f}:
            held = Counter((name(r), sha(body(r)), len(body(r).encode())) for r in rows if r[0] is not None and r[0] // 4_096 == f and r[0] % 4_096 == slot)
            level[slot] = (sum(n * k for (*_, n), k in held.items()), sha(f"0 {f} {slot}\n" + "\n".join(sorted(f"{a} {b} {c} {k}" for (a, b, c), k in held.items()))))
        for k in (1, 2, 3):
            above = {}
            for no in sorted(level):
                above.setdefault(no // 16 if k < 3 else 0, []).append(no)
            new_level = {}
            for up, nos in above.items():
                text, at = f"{k} {f} {up}\n", 0
                for no in nos:
                    text += f"{no} {at} {level[no][0]} {level[no][1]}\n"
                    at += level[no][0]
                new_level[up] = (at, sha(text))
            level = new_level
        assert set(out[out.file_no == f].root_sha256) == {level[0][1]}


# ---------------------------------------------------------------- 5


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inv = {}
    for i, s in enumerate(sets):
        for g in s:
            inv.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in inv[g] if j < i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=str)


def test_jaccard(docs, no_docs, corpus):
    for df in (docs, corpus):
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()), key=str)
        assert got == brute_components(texts_of(df))
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_jaccard_near_copies(spark):
    """A large group of near copies with edits, among which only some pairs link."""
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            w[k] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_clusters(spark, monkeypatch):
    """Several families of near copies, which share shingles but not all links, in groups of a few nodes: hubs, visits and
    pairs of lone nodes all take part, and no pair is verified twice."""
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "LEADERS", 2)
    rng = np.random.default_rng(3)
    common, rows = [f"c{i}" for i in range(40)], []
    for f in range(6):
        base = [f"w{f}_{i}" for i in range(30)] + common[: 10 + 5 * f]
        for _ in range(25):
            w = list(base)
            for k in rng.integers(0, len(w), rng.integers(0, 5)):
                w[k] = f"x{rng.integers(30)}"
            rows.append((len(rows), " ".join(w[: rng.integers(len(w) - 6, len(w) + 1)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == brute_components(rows) and len({c for *_, c in got}) > 6


def test_visits_skip_compared_pairs():
    """A visitor isn't compared again with hosts that it met at a hub, visited, or was visited by."""
    import pyarrow as pa

    x = [np.arange(k, 100 + k, dtype=np.uint64) for k in range(5)]
    table = lambda was, went, tried: pa.table({"host": [1] * 5, "salt": [0] * 5, "node": pa.array(range(5), pa.int64()), "guest": [True] + [False] * 4, "hashes": [jaccard_join.packed_set(s) for s in x], "was": pa.array(was, pa.int64()), "went": pa.array(went, pa.int64()), "tried": pa.array(tried, pa.list_(pa.int64()))})
    visit = lambda *a: jaccard_join._visit(75)(table(*a)).to_pylist()
    none = [None] * 5
    assert visit([9, 1, 1, 1, 1], none, none) == [{"a": 1, "b": 0}]
    assert visit([9, 1, 1, 2, 1], [1, *none[1:]], none) == [{"a": 3, "b": 0}]
    assert visit([9, 1, 1, 1, 1], [None, 9, 9, None, None], none) == [{"a": 3, "b": 0}]
    assert visit([9, 1, 1, 1, 1], none, [[1], None, [0], [0], None]) == [{"a": 4, "b": 0}]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1))
def test_filters_are_safe(a, b):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert jaccard_join.suffix_bound(x, y) >= len(a & b)
    assert bool(jaccard_join.linked(x, y, 75)) == (100 * len(a & b) >= 75 * len(a | b))
    differ = sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(jaccard_join.parity_bits(x), jaccard_join.parity_bits(y), strict=True))
    assert differ <= len(a ^ b)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(5, 5), (3, 4), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert all(got[i] == i // 20 * 20 for i in got if i < 60)


# ---------------------------------------------------------------- 6


def test_vectors(spark, no_docs):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 8))
    rows = [(i, (base[i % 20] + rng.normal(scale=0.05, size=8)).tolist(), i % 3) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, None, 1), (302, [0.0] * 8, 1), (303, [float("nan")] * 8, 1), (304, rows[3][1], None), (305, [None] + [1.0] * 7, 1), (306, [], 1), (307, [1.0, 2.0], 1), (308, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pq_neighbors.near_vectors(df).collect()}
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links = {i: set() for i, *_ in rows}
    for i, v, a in rows:
        for j, u, b in rows:
            if i < j and a == b and a is not None and ok(v) and ok(u) and len(u) == len(v) and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                links[i].add(j), links[j].add(i)

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        return min(seen)

    assert got == {i: (len(links[i]), least(i), least(i) == i) for i in links}
    assert pq_neighbors.near_vectors(df.limit(0)).count() == 0


def test_vectors_in_parts(spark, monkeypatch):
    """Lists in several parts, columns of clashing names, repeated ids, huge and tiny components."""
    monkeypatch.setattr(pq_neighbors, "LIST_ROWS", 16)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 12))
    rows = [(i, (base[i % 6] * 10.0 ** (i % 5 * 75 - 150) + 0).tolist() if i < 40 else (base[i % 6] + rng.normal(scale=0.06, size=12)).tolist(), i % 2, "x", 0.5) for i in range(400)]
    rows.append((399, rows[5][1], 1, "y", 0.5))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string, weight double")
    x = np.array([r[1] for r in rows])
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    got = sorted((r["vec_id"], r["n_links"]) for r in pq_neighbors.near_vectors(df).collect())
    assert got == sorted(zip([r[0] for r in rows], near.sum(1).tolist(), strict=True)) and near.sum() > 5_000


def test_vectors_recall(spark):
    """Links in 64 dimensions, near the limit and over many lists, against brute force (the contract asks for 0.9)."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1_500, 64))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * rng.uniform(0.05, 0.22, (1_500, 1)), base[:300] + rng.normal(size=(300, 64)) * 0.15])
    label = np.concatenate([np.arange(1_500), np.arange(1_500), np.arange(300)]) % 2
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in pq_neighbors.near_vectors(df).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.995 * near.sum() > 2_000


# ---------------------------------------------------------------- 7


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAeé ▁\n\t 中\U0001f642thersonin0129.-=\0<s>", max_size=80))
def test_pieces_match_the_library(text):
    sp = _library()
    m = piece_bpe.model_at(piece_bpe.model_path())
    ids = np.frombuffer(m.encode(text), "<u4").tolist()
    assert ids == sp.encode(text) and m.decode(m.encode(text)) == sp.decode(ids)


_kept = []


def _library():
    import sentencepiece

    if not _kept:
        _kept.append(sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path()))
    return _kept[0]


def test_pieces(docs, no_docs):
    sp = _library()
    r = {x["doc_id"]: x for x in piece_bpe.token_digest(docs).collect()}
    for i, t in texts_of(docs):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert (r[i]["n_tokens"], r[i]["ids_sha256"], r[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    back = {x["doc_id"]: x["text"] for x in piece_bpe.decode_ids(piece_bpe.encode_texts(docs)).collect()}
    assert back[1] == dict(texts_of(docs))[1] and piece_bpe.token_digest(no_docs).count() == 0


# ---------------------------------------------------------------- 8


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_scores(docs, no_docs, order):
    rows = [(i, t) for i, t in texts_of(docs)]
    seqs = [["<b>"] * (order - 1) + words(t) + ["</end>"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = [Counter() for _ in range(order + 1)]
    ctx = [Counter() for _ in range(order + 1)]
    for s, h in zip(seqs, held, strict=True):
        if not h:
            for p in range(order - 1, len(s)):
                for k in range(1, order + 1):
                    c[k][tuple(s[p - k + 1 : p + 1])] += 1
                    ctx[k][tuple(s[p - k + 1 : p])] += 1
    n, v = sum(c[1].values()), len(c[1])
    want = []
    for (i, _), s, h in zip(rows, seqs, held, strict=True):
        base = score = known = 0
        for p in range(order - 1, len(s)):
            q = (c[1][(s[p],)] + 1) / (n + v + 1)
            base += math.log10(q)
            known += c[1][(s[p],)] > 0
            for k in range(2, order + 1):
                q = (c[k][tuple(s[p - k + 1 : p + 1])] + 2.0 * q) / (ctx[k][tuple(s[p - k + 1 : p])] + 2.0)
            score += math.log10(q)
        want.append((i, h, len(s) - order + 1, known, n, round(base, 6), round(score, 6)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm_automaton.score_documents(docs, order).collect()]
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)
    assert lm_automaton.score_documents(no_docs, order).count() == 0


def test_automaton_is_a_model(docs):
    """Every state's arcs, with what its failure arcs pass on, sum to one over all tokens and an unknown one."""
    rows = [(i, (t or "")[:2_000]) for i, t in texts_of(docs)]
    texts = [t.encode() for _, t in rows]
    b = blocks.Block(blocks.squeeze(np.array([i or 0 for i, _ in rows]), np.zeros(len(rows), np.uint8), np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8), np.zeros(0, np.uint8)))
    keys, counts = lm_automaton.gram_counts(3, 10**9, 48)(b)
    grams = lm_automaton.Grams(b, 3, 48)
    single = keys < lm_automaton.SINGLE
    a = lm_automaton.Automaton(grams, 3, keys, counts, int(counts[single].sum()), int((counts[single] > 0).sum()), 2.0)

    def spread(state):
        own = {int(k % a.tokens): 10**w for k, w in zip(a.arcs, a.weights, strict=True) if k // a.tokens == state}
        if state == 0:
            return own, 10**a.unknown
        below, rest = spread(int(a.fail[state]))
        passed = 10 ** a.fail_weight[state]
        return {t: own[t] if t in own else p * passed for t, p in below.items()}, rest * passed

    rng = np.random.default_rng(0)
    for state in {0, 1, 2, a.start, *rng.integers(0, len(a.fail), 20).tolist()}:
        arcs, unknown = spread(state)
        assert abs(sum(arcs.values()) + unknown - 1) < 1e-9


# ---------------------------------------------------------------- counts over blocks


@pytest.mark.parametrize("fan", [10**6, 3, 1])
def test_totals_over_many_blocks(spark, monkeypatch, fan):
    """Direct exchange, and several merging steps; totals beyond 32 bits; keys at the ends of their range."""
    monkeypatch.setattr(blocks, "FAN", fan)
    monkeypatch.setattr(blocks, "RADIX", 3)
    rows = [(i, f"{i % 7} {i % 11} x{i} 4294967295" if i % 5 else None) for i in range(90)]
    made = blocks.blocks_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=60)

    def keys(block):
        found = Counter(int(w.strip("x")) * (1 << 20) % ((1 << 53) - 1) for t in np.split(block.bytes, block.starts[1:-1]) for w in t.tobytes().decode().split())
        return np.array(sorted(found), np.uint64), np.array([found[k] * 3_000_000_000 for k in sorted(found)], np.int64)

    n = made.count()
    assert n >= 20
    told = blocks.count_keys(made, keys, n, 53, lambda k, t: (len(k), int(t.max())))
    got = blocks.with_replies(made, told.select("g", "bucket", "reply")).collect()
    want = Counter()
    for r in got:
        k, c = keys(blocks.Block(r["data"]))
        want.update(dict(zip(k.tolist(), c.tolist(), strict=True)))
    for r in got:
        k, _ = keys(blocks.Block(r["data"]))
        assert blocks.joined_reply(r["replies"]).tolist() == [want[x] for x in k.tolist()]
    assert told.agg(F.sum("t0"), F.max("t1")).first()[:] == (len(want), max(want.values())) and max(want.values()) > 2**37


def test_word_hashes():
    """Equal words only have equal hashes; polynomials modulo 2**64 give a Thue-Morse word and its complement one hash."""
    ab = [0]
    while len(ab) < 4_096:
        ab += [1 - x for x in ab]
    texts = [f"{s[:n]} {s[:n].upper()}" for n in (1, 7, 8, 9, 64, 127, 128, 129, 1_024, 4_096) for s in ("".join("ab"[x] for x in ab), "".join("ba"[x] for x in ab))]
    raw = [t.encode() for t in texts]
    b = blocks.Block(blocks.squeeze(np.arange(len(raw)), np.zeros(len(raw), np.uint8), np.array([len(t) for t in raw]), np.frombuffer(b"".join(raw), np.uint8), np.zeros(0, np.uint8)))
    h, of, number = blocks.word_hashes(b)
    assert (number == 2).all() and (h[::2] == h[1::2]).all() and len(np.unique(h)) == len(raw)


# ---------------------------------------------------------------- 9


def brute_repeats(rows, size=200):
    c = Counter(b[k : k + size] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - size + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if c[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 4_000])
def test_repeats(docs, no_docs, hot):
    rows = [(i, t if t is None or len(t) < 20_000 else t[:3_000]) for i, t in texts_of(docs)]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, hot_units=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    clean = suffix_dedup.clean_texts(docs)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} >= {1, 3, 4, 6, 8, 9, 14}


@pytest.mark.parametrize("bits", [24, 10])
def test_anchors_in_stretches(bits):
    """The leftmost of the smallest hashes, also where a block is taken in stretches."""
    h = np.random.default_rng(1).integers(0, 40, 5_000).astype(np.uint64) << np.uint64(40)
    want = [i + int(np.argmin(h[i : i + 169])) for i in range(len(h) - 168)]
    assert suffix_dedup.leftmost_least(h, 169, bits).tolist() == want


def test_repeats_in_long_texts(spark):
    """Texts of several hundred kilobytes, whole, next to small ones that share a passage with them."""
    long = " ".join(f"word{i * i * 7919 % 99991 + i}" for i in range(30_000))
    rows = [(1, long), (2, "x" + long[100_000:100_450] + "y"), (3, long[200_000:200_199]), (4, long[-260:]), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {1: (710, 2), 2: (450, 1), 3: (0, 0), 4: (260, 1), 5: (0, 0)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\0\xff", max_size=90), min_size=1, max_size=6))
def test_suffix_array(texts):
    arrays = [np.frombuffer(t.encode("latin-1"), np.uint8) for t in texts]
    c = Counter(a[i : i + 16].tobytes() for a in arrays for i in range(len(a) - 15))
    got = suffix_dedup.repeated_starts(arrays, 16)
    assert [g.tolist() for g in got] == [[c[a[i : i + 16].tobytes()] > 1 for i in range(len(a) - 15)] for a in arrays]


# ---------------------------------------------------------------- the pipeline


def test_pipeline(spark, sf, tmp_path, docs, no_docs):
    import corpus_pipeline

    for start in (spark.read.parquet(f"{sf}/documents.parquet"), docs.drop("node", "score"), no_docs.drop("node", "score")):
        now = start
        for k, (name, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, now, sf)
            place = str(tmp_path / f"{id(start)}-{k}")
            out.write.parquet(place)
            after = spark.read.parquet(place)
            if k < 3:
                assert after.columns == start.columns
            if k == 0:
                model = toxicity.train(now, spark.read.parquet(f"{sf}/labels.parquet"))
                kept = [(i, t) for i, t in texts_of(now) if model.score(t) < toxicity.THRESHOLD]
                assert sorted(map(str, texts_of(after))) == sorted(map(str, kept))
            if k == 2 and max((len(t or "") for _, t in texts_of(now)), default=0) < 150_000:
                rows_ = texts_of(now)
                raw = [(t or "").encode() for _, t in rows_]
                times = Counter(b[j : j + 200] for b in raw for j in range(len(b) - 199))
                want = []
                for (i, t), b in zip(rows_, raw, strict=True):
                    gone = np.zeros(len(b), bool)
                    for j in range(len(b) - 199):
                        if times[b[j : j + 200]] > 1:
                            gone[j : j + 200] = True
                    left = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
                    if not gone.any() or left.strip():
                        want.append((i, left if t is not None else None))
                assert sorted(map(str, texts_of(after))) == sorted(map(str, want))
            if k == 1:
                brute = brute_components(texts_of(now))
                gone = {i for i, _, c in brute if i is not None and i != c}
                assert sorted(str(r["doc_id"]) for r in after.collect()) == sorted(str(i) for i, _ in texts_of(now) if i not in gone)
            if k == 3:
                check_packing(after.toPandas(), texts_of(now))
            now = after
    assert corpus_pipeline.run(spark, sf).count() > 0
