"""Golden fixtures: the reference's shipped per-run confusion cells and the

``check(spark)`` recomputes every shipped summary cell from the cells with
textlab's metric operators and counts the matches (tolerance 5e-4, the
files' 3-decimal rounding; majority logs 1e-8).
"""

from __future__ import annotations

import itertools

# --- fixed values: shipped confusion cells and summaries ---
# confusion cells, row-major truth x prediction, seeds 1234 / 3456 / 5678 (FIXTURES.md F4)
F4 = {
    ("NYT", "ROB-BASE"): ["136 12 10 42", "137 11 10 42", "132 16 9 43"],
    ("NYT", "ROB-LRG"): ["140 8 5 47", "136 12 6 46", "137 11 7 45"],
    ("NYT", "DEB-V3"): ["137 11 6 46", "140 8 4 48", "134 14 5 47"],
    ("NYT", "ELE-LRG"): ["134 14 9 43", "138 10 9 43", "138 10 7 45"],
    ("NYT", "XLNET-LRG"): ["129 19 6 46", "128 20 7 45", "97 51 13 39"],
    ("KAV", "ROB-BASE"): ["78 10 18 94", "77 11 19 93", "78 10 16 96"],
    ("KAV", "ROB-LRG"): ["80 8 8 104", "82 6 11 101", "85 3 10 102"],
    ("KAV", "DEB-V3"): ["82 6 9 103", "84 4 5 107", "83 5 10 102"],
    ("KAV", "ELE-LRG"): ["0 88 0 112", "75 13 23 89", "78 10 21 91"],
    ("KAV", "XLNET-LRG"): ["79 9 27 85", "78 10 21 91", "71 17 20 92"],
    ("ANG", "ROB-BASE"): ["136 17 10 37", "138 15 12 35", "142 11 11 36"],
    ("ANG", "ROB-LRG"): ["138 15 10 37", "141 12 11 36", "137 16 9 38"],
    ("ANG", "DEB-V3"): ["140 13 12 35", "140 13 12 35", "142 11 12 35"],
    ("ANG", "ELE-LRG"): ["0 153 0 47", "0 153 0 47", "141 12 12 35"],
    ("ANG", "XLNET-LRG"): ["144 9 12 35", "141 12 11 36", "143 10 12 35"],
    ("BRX", "ROB-BASE"): ["16 6 3 9 142 11 0 4 9", "19 4 2 11 139 12 0 3 10", "17 6 2 9 139 14 0 1 12"],
    ("BRX", "ROB-LRG"): ["11 12 2 3 156 3 0 2 11", "11 12 2 3 156 3 0 4 9", "10 12 3 3 153 6 0 3 10"],
    ("BRX", "DEB-V3"): ["12 11 2 3 159 0 0 2 11", "15 8 2 3 157 2 0 2 11", "16 7 2 4 157 1 0 1 12"],
    ("BRX", "ELE-LRG"): ["14 9 2 6 151 5 0 2 11", "12 12 1 4 156 2 0 2 11", "11 13 1 6 153 3 0 4 9"],
    ("BRX", "XLNET-LRG"): ["15 8 2 5 147 10 0 2 11", "18 5 2 8 144 10 0 1 12", "17 6 2 7 147 8 0 1 12"],
    ("ANG", "ELE-BS-GER"): ["140 13 11 36", "140 13 11 36", "138 15 9 38"],
}

B2 = {
    ("NYT", "DEB-V3"): [(0.92, 0.015), (0.925, 0.012), (0.92, 0.015), (0.9, 0.017), (0.921, 0.014)],
    ("NYT", "ELE-LRG"): [(0.902, 0.012), (0.904, 0.011), (0.902, 0.012), (0.875, 0.015), (0.903, 0.012)],
    ("NYT", "ROB-BASE"): [(0.887, 0.008), (0.89, 0.006), (0.887, 0.008), (0.856, 0.009), (0.888, 0.008)],
    ("NYT", "ROB-LRG"): [(0.918, 0.012), (0.922, 0.011), (0.918, 0.012), (0.897, 0.014), (0.919, 0.011)],
    ("NYT", "XLNET-LRG"): [(0.807, 0.09), (0.846, 0.057), (0.807, 0.09), (0.779, 0.091), (0.816, 0.083)],
    ("KAV", "DEB-V3"): [(0.935, 0.014), (0.936, 0.014), (0.935, 0.014), (0.934, 0.014), (0.935, 0.014)],
    ("KAV", "ELE-LRG"): [(0.742, 0.129), (0.663, 0.248), (0.742, 0.129), (0.674, 0.223), (0.689, 0.203)],
    ("KAV", "ROB-BASE"): [(0.86, 0.008), (0.863, 0.008), (0.86, 0.008), (0.859, 0.008), (0.86, 0.008)],
    ("KAV", "ROB-LRG"): [(0.923, 0.008), (0.925, 0.009), (0.923, 0.008), (0.923, 0.009), (0.923, 0.009)],
    ("KAV", "XLNET-LRG"): [(0.827, 0.013), (0.834, 0.014), (0.827, 0.013), (0.826, 0.013), (0.827, 0.013)],
    ("ANG", "DEB-V3"): [(0.878, 0.005), (0.879, 0.004), (0.878, 0.005), (0.831, 0.005), (0.878, 0.004)],
    ("ANG", "ELE-LRG"): [(0.45, 0.304), (0.33, 0.389), (0.45, 0.304), (0.405, 0.303), (0.353, 0.373)],
    ("ANG", "ROB-BASE"): [(0.873, 0.012), (0.877, 0.009), (0.873, 0.012), (0.828, 0.013), (0.875, 0.011)],
    ("ANG", "ROB-LRG"): [(0.878, 0.005), (0.883, 0.002), (0.878, 0.005), (0.836, 0.004), (0.88, 0.004)],
    ("ANG", "XLNET-LRG"): [(0.89, 0.004), (0.889, 0.003), (0.89, 0.004), (0.846, 0.004), (0.889, 0.003)],
    ("ANG", "ELE-BS-GER"): [(0.88, 0.0), (0.884, 0.002), (0.88, 0.0), (0.837, 0.002), (0.881, 0.001)],
    ("BRX", "DEB-V3"): [(0.917, 0.006), (0.913, 0.008), (0.917, 0.006), (0.818, 0.018), (0.912, 0.009)],
    ("BRX", "ELE-LRG"): [(0.88, 0.012), (0.875, 0.014), (0.88, 0.012), (0.749, 0.028), (0.874, 0.013)],
    ("BRX", "ROB-BASE"): [(0.838, 0.002), (0.873, 0.008), (0.838, 0.002), (0.704, 0.016), (0.85, 0.004)],
    ("BRX", "ROB-LRG"): [(0.878, 0.01), (0.876, 0.008), (0.878, 0.01), (0.723, 0.025), (0.87, 0.01)],
    ("BRX", "XLNET-LRG"): [(0.872, 0.006), (0.892, 0.006), (0.872, 0.006), (0.754, 0.015), (0.878, 0.006)],
}
ORDER = ["accuracy", "precision", "recall", "f1_macro", "f1_weighted"]
SEEDS = [1234, 3456, 5678]




def cell_rows(key, seed, cells):
    counts = [int(x) for x in cells.split()]
    k = int(round(len(counts) ** 0.5))
    for (t, p), n in zip(itertools.product(range(k), range(k)), counts):
        yield from ((key[0], key[1], seed, t, p) for _ in range(n))


F5 = {
    "NYT": ["143 5 52 0", "101 47 34 18", "113 35 11 41", "134 14 6 46", "134 14 5 47"],
    "KAV": ["40 48 57 55", "78 10 76 36", "51 37 32 80", "73 15 18 94", "82 6 10 102"],
    "ANG": ["137 16 39 8", "92 61 24 23", "117 36 11 36", "137 16 13 34", "142 11 12 35"],
    "BRX": ["0 25 0 1 161 0 0 13 0", "0 25 0 0 162 0 0 13 0", "0 25 0 0 162 0 0 13 0",
            "16 7 2 26 122 14 4 1 8", "11 10 4 8 144 10 0 4 9"],
}
B3 = {
    "NYT": [(0.715, 0.543, 0.715, 0.417, 0.617), (0.595, 0.626, 0.595, 0.511, 0.608), (0.77, 0.815, 0.77, 0.736, 0.781),
            (0.9, 0.908, 0.9, 0.876, 0.902), (0.905, 0.914, 0.905, 0.883, 0.907)],
    "KAV": [(0.475, 0.48, 0.475, 0.472, 0.477), (0.57, 0.661, 0.57, 0.55, 0.539), (0.655, 0.653, 0.655, 0.648, 0.654),
            (0.835, 0.836, 0.835, 0.833, 0.835), (0.92, 0.921, 0.92, 0.919, 0.92)],
    "ANG": [(0.725, 0.674, 0.725, 0.529, 0.69), (0.575, 0.671, 0.575, 0.518, 0.606), (0.765, 0.817, 0.765, 0.719, 0.779),
            (0.855, 0.858, 0.855, 0.803, 0.857), (0.885, 0.884, 0.885, 0.839, 0.885)],
    "BRX": [(0.805, 0.655, 0.805, 0.297, 0.722), (0.81, 0.656, 0.81, 0.298, 0.725), (0.81, 0.656, 0.81, 0.298, 0.725),
            (0.73, 0.825, 0.73, 0.573, 0.761), (0.82, 0.836, 0.82, 0.633, 0.824)],
}
SIZES = [50, 100, 200, 500, 1000]


# part A class counts and majority-baseline metrics (FIXTURES.md F3)
F3 = {
    "NYT": ([852, 322], (0.725724020, 0.526675354, 0.725724020, 0.420533070, 0.610381901)),
    "KAV": ([586, 587], (0.500426257, 0.250426439, 0.500426257, 0.333522727, 0.333807060)),
    "ANG": ([5523, 2246], (0.710902304, 0.505382086, 0.710902304, 0.415513091, 0.590778427)),
    "BRX": ([267, 2602, 280], (0.826294062, 0.682761876, 0.826294062, 0.301628702, 0.747702016)),
}



TOL = 5e-4 + 1e-9


def check(spark) -> tuple[int, int]:
    """(matched, total) summary cells over B2, B3 and the majority logs."""
    from textlab.operators import metrics as M
    matched = total = 0
    rows = [r for key, per_seed in F4.items() for seed, c in zip(SEEDS, per_seed) for r in cell_rows(key, seed, c)]
    df = spark.createDataFrame(rows, "ds string, model string, seed int, y_true int, y_pred int")
    rep = M.classification_report(df, ["ds", "model", "seed"], digits=None)
    summ = {(r.ds, r.model, r.metric): (r.mean, r.std) for r in M.seeds_summary(rep, ["ds", "model"]).collect()}
    for key, expected in B2.items():
        for metric, (mean, std) in zip(ORDER, expected):
            got = summ[(key[0], key[1], metric)]
            total += 2
            matched += (abs(got[0] - mean) <= TOL) + (abs(got[1] - std) <= TOL)
    rows = [(ds, n, t, p) for ds, per_size in F5.items() for n, c in zip(SIZES, per_size)
            for (_, _, _, t, p) in cell_rows((ds, "x"), 0, c)]
    df = spark.createDataFrame(rows, "ds string, n_train int, y_true int, y_pred int")
    rep = {(r.ds, r.n_train): r for r in M.classification_report(df, ["ds", "n_train"], digits=None).collect()}
    for ds, per_size in B3.items():
        for n, expected in zip(SIZES, per_size):
            for metric, want in zip(ORDER, expected):
                total += 1
                matched += abs(getattr(rep[(ds, n)], metric) - want) <= TOL
    rows = [(ds, c) for ds, (counts, _) in F3.items() for c, n in enumerate(counts) for _ in range(n)]
    df = spark.createDataFrame(rows, "ds string, label int")
    maj = {r.ds: r for r in M.majority_baseline(df, "label", ["ds"], digits=None).collect()}
    for ds, (_, want) in F3.items():
        r = maj[ds]
        for got, w in zip((r.accuracy, r.precision, r.recall, r.f1_macro, r.f1_weighted), want):
            total += 1
            matched += abs(got - w) <= 1e-8
    return int(matched), total
