"""The URL filter against a plain walk down each host's tree."""

import collections
import re

import numpy as np

from panelspark.llm import urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = [(len(h + p), h + p, kind) for kind, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def trees(paths):
    """Template of every (host, path), one node at a time from the root."""
    out, nodes = {}, [((), [(p, p[1].split("/")[1:]) for p in sorted(paths) if p[0] == host]) for host in {h for h, _ in paths}]
    while nodes:
        template, members = nodes.pop()
        depth = len(template)
        for p, segments in members:
            if len(segments) == depth:
                out[p] = "".join("/" + s for s in template)
        members = [m for m in members if len(m[1]) > depth]
        if len(members) < urls.FEWEST:
            out |= {p: "".join("/" + s for s in (*template, *["*"] * (len(segments) - depth))) for p, segments in members}
            continue
        count = collections.Counter(s[depth] for _, s in members)
        literal = {s for s, n in count.items() if s and n >= urls.FEWEST and n - urls.Z * n**0.5 >= urls.SHARE * len(members)}
        below = collections.defaultdict(list)
        for m in members:
            below[m[1][depth] if m[1][depth] in literal else "*"].append(m)
        nodes += [((*template, s), of) for s, of in below.items()]
    return out


def like(hits, of, all_hits, all_of):
    others, other_hits, p = all_of - of, all_hits - hits, all_hits / all_of if all_of else 0
    return (hits * others - other_hits * of) ** 2 <= urls.Z**2 * p * (1 - p) * of * others * all_of


def walked(pages):
    paths = {split(u) for _, u in pages}
    template = trees(paths)
    each, nodes = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.defaultdict(lambda: [0, 0, 0, 0])
    node_of = lambda t: t.rsplit("/", 1)[0] if "/" in t else ""
    for host, path in paths:
        verdict, t = ruled(host, path)[1], template[host, path]
        found = (verdict is not None, verdict == "block", 1, bool(re.search("/[0-9][^/]*$", path)))
        for table, key in ((each, (host, t)), (nodes, (host, node_of(t)))):
            table[key] = [a + b for a, b in zip(table[key], found, strict=True)]
    total, blocked = sum(x[0] for x in each.values()), sum(x[1] for x in each.values())
    merged = {k: like(x[1], x[0], y[1], y[0]) and like(x[3], x[2], y[3], y[2]) for k, x in each.items() for y in [nodes[k[0], node_of(k[1])]]}
    rejected = {}
    for k, x in each.items():
        mates = [v for q, v in each.items() if merged[q] and q[0] == k[0] and node_of(q[1]) == node_of(k[1])] if merged[k] else [x]
        n, b = sum(v[0] for v in mates), sum(v[1] for v in mates)
        rejected[k] = n > 0 and (b + urls.SMOOTH * blocked / total) / (n + urls.SMOOTH) >= urls.PURITY
    out = []
    for page, u in pages:
        host, path = split(u)
        rule, verdict = ruled(host, path)
        out.append((page, host, path, rule, verdict or ("block" if rejected[host, template[host, path]] else "allow"), template[host, path]))
    return out


def made(rng, n):
    hosts, out = ["a.com", "EXAMPLE.com", "w.example.net", "de.net", "x.org", "plain.edu"], []
    first = ["en", "de", "es", "blog", "tag", "user"]
    for i in range(n):
        host = str(rng.choice(hosts))
        segments = [str(rng.choice(first)) if rng.random() < 0.6 else f"{rng.integers(400)}"]
        while rng.random() < 0.6 and len(segments) < 8:
            segments.append(str(rng.choice([f"{rng.integers(1000)}", f"p{rng.integers(4)}", "view", "", f"slug-{rng.integers(60)}"])))
        url = f"http://{host}/{'/'.join(segments)}" + str(rng.choice(["", "?q=1", "#f", "/"]))
        out.append((i, url))
    return [*out, (n, None), (n + 1, "no scheme"), (n + 2, "x://"), (n + 3, "x://h"), *out[:5]]


def test_filter_equals_a_walk_down_the_trees(spark):
    for seed, n in ((1, 60), (2, 900)):
        pages = made(np.random.default_rng(seed), n)
        found = urls.judged(spark.createDataFrame(pages, "page_id long, url string"))
        order = lambda r: (r[0], str(r))
        assert sorted(map(tuple, found.select("page_id", "host", "path", "rule", "verdict", "template").collect()), key=order) == sorted(walked(pages), key=order)


def test_a_template_of_blocked_labels_rejects_urls_without_a_rule(spark):
    """One segment of many at its node is variable; so urls beside the blocked ones share their template."""
    pages = [(i, f"http://h.com/{c}{i}/{i}{k}") for i, (c, k) in enumerate((c, k) for c in "abcdefgh" for k in range(5))] + [(100 + k, f"http://h.com/en/900{k}") for k in range(2)]
    pages += [(200 + i, f"http://k.com/en/{i}") for i in range(20)] + [(300, "http://k.com/fr/1")]
    found = {r["page_id"]: (r["template"], r["rule"], r["verdict"]) for r in urls.judged(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert found[0] == ("/*/*", None, "block") and found[100] == ("/*/*", "com/en/", "block")
    assert sorted((k, v) for k, v in found.items()) == sorted((r[0], (r[5], r[3], r[4])) for r in walked(pages))


def test_branches_of_other_segments_are_not_merged(spark):
    """Branches without labels take their siblings' share if their last segments are like theirs, and not otherwise."""
    rows = [("h", "/a", "/a/en", f"/a/en/{i}", "block") for i in range(20)] + [("h", "/a", "/a/x", f"/a/x/{i}", None) for i in range(20)]
    rows += [("h", "/a", "/a/word", f"/a/word/w{i}", None) for i in range(40)]
    found = {r["template"]: r["rejected"] for r in urls.purity(spark.createDataFrame(rows, "host string, node string, template string, path string, verdict string")).collect()}
    assert found == {"/a/en": True, "/a/x": False, "/a/word": False}
    same = [r for r in rows if r[2] != "/a/word"]
    assert {r["rejected"] for r in urls.purity(spark.createDataFrame(same, "host string, node string, template string, path string, verdict string")).collect()} == {True}
