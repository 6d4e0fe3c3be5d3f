import numpy as np
import pandas as pd


def auc(score, label) -> float:
    """Chance that a positive row scores above a negative one."""
    label = np.asarray(label).astype(bool)
    ranks = pd.Series(np.asarray(score, dtype=float)).rank().to_numpy()
    positive = int(label.sum())
    return (ranks[label].sum() - positive * (positive + 1) / 2) / (positive * (len(label) - positive))
