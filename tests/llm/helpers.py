"""Small tables with the awkward cases, and brute-force versions."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, quality string, `odd.name` int"
PROSE = "The of and to in is that it for was on are as with his they at be this from or had by but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part"


def awkward(spark):
    """Nulls everywhere, empty, blank and long texts, repeated rows, clashing and dotted extra columns."""
    long = " ".join(f"w{k} {PROSE}" for k in range(400))
    rows = [
        (1, PROSE, "en", "a", 1, "x", 1), (1, PROSE, "en", "a", 1, "x", 1), (2, None, "en", "a", None, None, None), (3, "", None, None, 0, "x", 1), (4, " \n\t ", "en", "b", 3, "x", 1),
        (None, PROSE, "en", "a", 1, "x", 1), (None, None, None, None, None, None, None), (5, long, "en", "b", 9, "x", 1), (6, "word", "en", "b", 4, "x", 1), (7, PROSE + " extra", "en", "a", 5, "x", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def components(sets, percent=80):
    """id -> least id reachable over links with 100 * intersection >= percent * union."""
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}
