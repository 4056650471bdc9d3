"""Plain-Python models that operators are held against."""


def newest(rows, key=("prefix", "key")):
    """Last write wins over dicts."""
    best = {}
    for r in rows:
        k = tuple((r[c] or "") if c == "prefix" else r[c] for c in key)
        rank = (r["ts_id"], r["version"], -r["tx_id"], r["seq"])
        if k not in best or rank > best[k][0]:
            best[k] = (rank, r)
    return {k: r for k, (_, r) in best.items()}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
