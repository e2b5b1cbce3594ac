"""Brute-force miner for tests: one line at a time, plain lists, no blocks and no caches."""

W = "<*>"


def mine(texts, st, depth, limit=100):
    """Final template per line, for masked texts in order."""
    keys = max(depth - 3, 0)
    clusters, branches, owner = [], {}, []
    for text in texts:
        words = text.split()
        n = len(words)
        if n < depth - 2 or n == 0:
            clusters.append({"path": None, "words": words})
            owner.append(len(clusters) - 1)
            continue
        # Look up.
        path = (n,)
        for word in words[:keys]:
            options = branches.get(path, set())
            step = word if word in options else W if W in options else None
            if step is None:
                path = None
                break
            path += (step,)
        ranked = []
        for number, cluster in enumerate(clusters):
            if path is not None and cluster["path"] == path:
                same = sum(a == b != W for a, b in zip(cluster["words"], words))
                wild = cluster["words"].count(W)
                ranked.append((-same / n, -wild, number))
        if ranked and -min(ranked)[0] >= st:
            number = min(ranked)[2]
            old = clusters[number]["words"]
            clusters[number]["words"] = [a if a == b else W for a, b in zip(old, words)]
            owner.append(number)
            continue
        # Add.
        path = (n,)
        for word in words[:keys]:
            options = branches.setdefault(path, set())
            if word not in options:
                room = limit - len(options) - (W not in options)
                if any(c.isdigit() for c in word) or room <= 0:
                    word = W
                options.add(word)
            path += (word,)
        clusters.append({"path": path, "words": words})
        owner.append(len(clusters) - 1)
    return [" ".join(clusters[number]["words"]) for number in owner]
