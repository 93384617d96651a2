"""Plain versions that several tests use."""

from wardlight.llm.simhash import fingerprint


def groups_of(texts):
    """For each text a number of its group by chains of at most three differing bits."""
    prints = [fingerprint(t) for t in texts]
    top = list(range(len(prints)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                top[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]
