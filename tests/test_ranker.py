import numpy as np

from strainframe.operators import ranker


def plain_fit(x, y, w):
    """Gradient descent with a fixed small step on sum(w * loss) + |b|^2 / 2, as far as doubles go."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.ones(x.shape[1] - 1), 0.0)
    beta, rate = np.zeros(x.shape[1]), 1.0 / (0.25 * np.linalg.norm(x.T * np.sqrt(w), 2) ** 2 + 1)
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta - rate * (x.T @ (w * (p - y)) + penalty * beta)
    return beta


def test_newton_steps_equal_gradient_descent(spark):
    dice = np.random.default_rng(1)
    x = dice.normal(size=(120, 4))
    y = (x @ [1.5, -1, 0, 0.5] + dice.normal(size=120) > 0).astype(int)
    w = dice.choice([0.5, 1.0, 2.0], 120)
    rows = [([float(v) for v in row], int(t), float(k)) for row, t, k in zip(x, y, w, strict=True)]
    frame = spark.createDataFrame(rows, "z array<double>, target int, w double").repartition(3)
    assert np.allclose(ranker.newton_fit(frame, 4), plain_fit(x, y, w), atol=1e-6)


def test_separable_and_constant_features(spark):
    rows = [([float(n), 0.0], int(n > 5), 1.0) for n in range(12)]
    beta = ranker.newton_fit(spark.createDataFrame(rows, "z array<double>, target int, w double"), 2)
    assert np.isfinite(beta).all() and beta[0] > 0 and abs(beta[1]) < 1e-9
    assert np.allclose(beta, plain_fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.ones(12)), atol=1e-4)
