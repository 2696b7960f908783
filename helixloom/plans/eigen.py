"""SQL text for the leading eigenvectors of a small symmetric matrix, by repeated squaring."""

from __future__ import annotations


def eigen_sql(matrix: str, k: int, squarings: int = 18) -> str:
    """CTEs ending in eig(a, component, value): eigenvectors of ``matrix`` (a, b, v) times the root of their eigenvalues, with the
    largest entry positive. A matrix squared often enough has only its leading direction left, which is then taken out."""
    out, m = [], matrix
    for c in range(k):
        cur = m
        for i in range(squarings):
            nxt = f"sq{c}_{i}"
            out.append(f"{nxt} AS MATERIALIZED (SELECT a, b, v / max(abs(v)) OVER () AS v FROM (SELECT x.a, y.b, sum(x.v * y.v) AS v FROM {cur} x JOIN {cur} y ON x.b = y.a GROUP BY x.a, y.b) z)")
            cur = nxt
        out.append(f"vec{c} AS MATERIALIZED (SELECT a, v / sqrt(sum(v * v) OVER ()) AS v FROM (SELECT a, sum(v * s) AS v FROM {cur} JOIN (SELECT a AS b, v AS s FROM {cur} WHERE b = (SELECT a FROM {cur} WHERE a = b ORDER BY v DESC, a LIMIT 1)) p USING (b) GROUP BY a) z)")
        out.append(f"val{c} AS MATERIALIZED (SELECT sum(x.v * m.v * y.v) AS l FROM {m} m JOIN vec{c} x ON x.a = m.a JOIN vec{c} y ON y.a = m.b)")
        rest = f"rest{c}"
        out.append(f"{rest} AS MATERIALIZED (SELECT m.a, m.b, m.v - l * x.v * y.v AS v FROM {m} m JOIN vec{c} x ON x.a = m.a JOIN vec{c} y ON y.a = m.b, val{c})")
        m = rest
    parts = [f"SELECT vec{c}.a, {c}::INTEGER AS component, v * sqrt(l) * (SELECT CASE WHEN v < 0 THEN -1 ELSE 1 END FROM vec{c} ORDER BY round(abs(v), 9) DESC, a DESC LIMIT 1) AS value FROM vec{c}, val{c}" for c in range(k)]
    out.append("eig AS (" + " UNION ALL ".join(parts) + ")")
    return ",\n  ".join(out)
