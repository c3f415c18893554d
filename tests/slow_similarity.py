"""The similarity scores straight from their definitions, a pair at a time."""


def ratio(a, b):
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            kept = row[j]
            row[j] = diagonal + 1 if x == y else max(row[j], row[j - 1])
            diagonal = kept
    return 200.0 * row[-1] / (len(a) + len(b))


def partial_ratio(a, b):
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    n = len(short)
    return max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def token_sort_ratio(a, b, score=ratio):
    return score(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not only_a or not only_b):
        return 100.0
    whole_a, whole_b = f"{shared} {only_a}".strip(), f"{shared} {only_b}".strip()
    pairs = [(whole_a, whole_b)] + ([(shared, whole_a), (shared, whole_b)] if shared else [])
    return max(ratio(p, q) for p, q in pairs)


def partial_token_set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    return 100.0 if x & y else partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))


def weighted_ratio(a, b):
    if not a or not b:
        return 0.0
    plain = ratio(a, b)
    longer = max(len(a), len(b)) / min(len(a), len(b))
    words = max(token_sort_ratio(a, b), token_set_ratio(a, b))
    if longer < 1.5:
        return max(plain, 0.95 * words)
    scale = 0.9 if longer < 8 else 0.6
    windows = max(token_sort_ratio(a, b, partial_ratio), partial_token_set_ratio(a, b))
    return max(plain, scale * partial_ratio(a, b), 0.95 * scale * windows)


def best_score(a, b):
    return max(token_set_ratio(a, b), weighted_ratio(a, b)) if a and b else 0.0
