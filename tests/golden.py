"""Published curves and what is to be chosen on them."""

# Two published tau curves of (tau, clusters, largest fraction, normalised entropy, agreement with the previous tau).
LONGKOU = [
    (0.0, 303, 0.316273, 0.432902, None), (0.05, 301, 0.316273, 0.433402, 1.000000), (0.1, 298, 0.316273, 0.434031, 0.999996),
    (0.15, 280, 0.316273, 0.436008, 0.999392), (0.2, 263, 0.316273, 0.439783, 0.999967), (0.3, 221, 0.316273, 0.448212, 0.998726),
    (0.5, 110, 0.326732, 0.426994, 0.799240), (0.75, 42, 0.861786, 0.177409, 0.177289), (1.0, 17, 0.979232, 0.045071, 0.223608),
    (1.5, 7, 0.999541, 0.002381, 0.042129), (2.0, 2, 0.999986, 0.000240, 0.057659), (3.0, 2, 0.999986, 0.000240, 1.000000),
]
TRENTO = [
    (0.0, 213, 0.374378, 0.468852, None), (0.05, 213, 0.374378, 0.468852, 1.000000), (0.1, 211, 0.374378, 0.469659, 1.000000),
    (0.15, 200, 0.374378, 0.474187, 0.999998), (0.2, 187, 0.374378, 0.479774, 0.999994), (0.25, 179, 0.374378, 0.483633, 0.999998),
    (0.3, 165, 0.374378, 0.490381, 0.999970), (0.35, 153, 0.374378, 0.496733, 0.999949), (0.4, 138, 0.374408, 0.505605, 0.999904),
    (0.45, 130, 0.374408, 0.510548, 0.999971), (0.5, 123, 0.374408, 0.515324, 0.999984), (0.55, 111, 0.374408, 0.523445, 0.999788),
    (0.6, 98, 0.375131, 0.533245, 0.997630), (0.65, 82, 0.375131, 0.548069, 0.999296), (0.7, 70, 0.375693, 0.559933, 0.998255),
    (0.75, 68, 0.375693, 0.562353, 0.999937), (1.0, 1, 1.000000, 0.000000, 0.000000), (1.5, 1, 1.000000, 0.000000, 1.000000),
    (2.0, 1, 1.000000, 0.000000, 1.000000), (3.0, 1, 1.000000, 0.000000, 1.000000),
]
PIXELS = {"longkou": 220_000, "trento": 99_600}


def curves(spark):
    rows = [("longkou", *r) for r in LONGKOU] + [("trento", *r) for r in TRENTO]
    return spark.createDataFrame(rows, "curve string, tau double, k long, largest double, entropy double, ari_prev double")
