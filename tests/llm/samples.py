import random

#: Texts that every operator has to take: null, empty and long ones, ties, repeated ones.
ODD_TEXTS = [None, "", " \n\t", "word", "one two\nthree", "one two\nthree", "é" * 50, "x " * 3000, "l1\n" * 40]


def prose(seed, n):
    """n invented words."""
    r = random.Random(seed)
    return [r.choice("the on er an re ing ti st".split()) + r.choice("ab cd ef gh ij kl mn op".split()) + str(r.randint(0, 40)) for _ in range(n)]
