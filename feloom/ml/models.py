"""Models that score a dense feature matrix, and their configurations."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ElementTree
from dataclasses import dataclass, field

import numpy as np

from . import kernels
from .equalizer import EqualizerModel

# Steps; each takes and returns a matrix with one row per entity


def impute(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """NaN to the value of its column."""
    return np.where(np.isnan(x), values, x)


def binarize(x: np.ndarray, threshold: float = 0.0) -> np.ndarray:
    return (x > threshold).astype(float)


def scale(x: np.ndarray, scales: np.ndarray | None = None, means: np.ndarray | None = None) -> np.ndarray:
    x = x - means if means is not None else x
    return x / scales if scales is not None else x


def tfidf(x: np.ndarray, groups: list[list[int]], idf: list[np.ndarray] | None = None, sublinear: bool = False, norm: str | None = "l1") -> np.ndarray:
    """Per group of columns: log(x + 1), idf weights, and a norm of the row (a zero norm counts as 1)."""
    if idf is not None and [len(g) for g in groups] != [len(d) for d in idf]:
        raise ValueError("groups and idf weights differ in size")
    x = x.copy()
    for i, columns in enumerate(groups):
        part = np.log(x[:, columns] + 1) if sublinear else x[:, columns]
        part = part * np.asarray(idf[i]) if idf is not None else part
        if norm in ("l1", "l2"):
            size = np.abs(part).sum(axis=1) if norm == "l1" else np.sqrt((part**2).sum(axis=1))
            part = part / np.where(size == 0, 1.0, size)[:, None]
        x[:, columns] = part
    return x


def take(x: np.ndarray, columns: list[int]) -> np.ndarray:
    if not x.size:
        raise ValueError("nothing to take columns from")
    return x[:, columns]


def naive_bayes(x: np.ndarray, feature_log: np.ndarray, class_log: np.ndarray) -> np.ndarray:
    """Class probabilities of a multinomial model."""
    joint = x @ np.asarray(feature_log).T + np.asarray(class_log)
    return np.exp(joint - kernels.log_sum_exp(joint)[:, None])


def logistic(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Probabilities of the negative and the positive class."""
    p = 1 / (1 + np.exp(-(x @ np.asarray(weights) + bias)))
    return np.stack([1 - p, p], axis=1)


def guarded(predict, x: np.ndarray, least: int, most: int) -> np.ndarray:
    """All NaN where the number of features other than 0 is out of bounds."""
    used = (x != 0).sum(axis=1)
    out = predict(x)
    out[(used < least) | (used > most)] = np.nan
    return out


def pmml_regression(text: str) -> tuple[np.ndarray, float]:
    """Weights and intercept of a PMML regression table with most predictors."""
    tables = [t for t in ElementTree.fromstring(text).iter() if t.tag.rpartition("}")[2] == "RegressionTable"]
    table = max(tables, key=len)
    terms = [p for p in table if p.tag.rpartition("}")[2] == "NumericPredictor"]
    return np.array([float(p.get("coefficient")) for p in terms]), float(table.get("intercept", 0))


# Models: ``groups`` name the features, ``apply`` gives the columns of a scored row


@dataclass
class ModelBase:
    groups: list[tuple[str, list]]
    audience: str = ""
    equalizers: dict[str, EqualizerModel] = field(default_factory=dict)
    ok: bool = True

    def equalized(self, raw: np.ndarray, group: str = "") -> np.ndarray:
        """A postprocessor per group; the empty group without one is the identity."""
        if group in self.equalizers:
            return self.equalizers[group](raw)
        if group:
            raise KeyError(f"no equalizer for group {group!r}")
        return raw

    def apply(self, x: np.ndarray, group: str = "") -> dict:
        raw = self.raw(x)
        done = self.equalized(raw, group)
        return {"score": done, "scores_raw": raw[:, None], "scores_trf": done[:, None], "audience_name": self.audience, "category": "positive"}


@dataclass
class LookalikeBayes(ModelBase):
    """Imputed, binarised features in a multinomial model; the positive class, equalised."""

    fill: np.ndarray = None
    threshold: float = 0.0
    feature_log: np.ndarray = None
    class_log: np.ndarray = None
    least: int = 0
    most: int = 1 << 30

    def raw(self, x):
        x = binarize(impute(x, self.fill), self.threshold)
        return guarded(lambda z: naive_bayes(z, self.feature_log, self.class_log), x, self.least, self.most)[:, 1]


@dataclass
class LookalikeLogistic(ModelBase):
    """Imputed, weighted and scaled features in a logistic model; the positive class, equalised."""

    fill: np.ndarray = None
    tfidf_groups: list = None
    idf: list = None
    sublinear: bool = False
    norm: str | None = "l1"
    scales: np.ndarray = None
    means: np.ndarray = None
    weights: np.ndarray = None
    bias: float = 0.0
    least: int = 0
    most: int = 1 << 30

    def raw(self, x):
        x = impute(x, self.fill)
        x = scale(tfidf(x, self.tfidf_groups, self.idf, self.sublinear, self.norm), self.scales, self.means)
        return guarded(lambda z: logistic(z, self.weights, self.bias), x, self.least, self.most)[:, 1]


@dataclass
class AudienceScore(ModelBase):
    """Four profile features and topics above 0.1 as normalised log tf-idf, in a linear form."""

    weights: np.ndarray = None
    bias: float = 0.0
    idf: np.ndarray = None
    link: str = "sigmoid"
    PROFILE = (0.5, 0.5, 0.0, 0.0)
    LEAST_TOPIC = 0.1

    def raw(self, x):
        profile = impute(x[:, :4], np.array(self.PROFILE))
        topics = x[:, 4:]
        used = ~np.isnan(topics) & (topics > self.LEAST_TOPIC)
        tf = np.where(used, (1 + np.log(np.where(used, topics, 1.0))) * np.asarray(self.idf), 0.0)
        size = np.sqrt((tf**2).sum(axis=1, keepdims=True))
        tf = np.divide(tf, size, out=np.zeros_like(tf), where=size != 0)
        z = np.hstack([profile, tf]) @ np.asarray(self.weights) + self.bias
        return {"sigmoid": lambda: 1 / (1 + np.exp(z)), "linear": lambda: z, "neg_linear": lambda: -z}[self.link]()

    def apply(self, x, group=""):
        return {"score": self.raw(x), "scores_raw": None, "scores_trf": None, "audience_name": self.audience, "category": "positive"}


@dataclass
class Dummy(ModelBase):
    def raw(self, x):
        return np.zeros(len(x))


class Invalid(ModelBase):
    """Stands for a model that could not be made; it scores nothing."""

    def __init__(self, reason: str):
        super().__init__(groups=[], audience="", ok=False)
        self.reason = reason


KINDS = {"lookalike_bayes": LookalikeBayes, "lookalike_logistic": LookalikeLogistic, "audience_score": AudienceScore, "dummy": Dummy}


def make_model(config: dict | str) -> ModelBase:
    """From a dict or its JSON: ``type``, the fields of that model, ``equalizers`` by group, ``pmml`` for a logistic one."""
    try:
        given = dict(json.loads(config) if isinstance(config, str) else config)
        kind = KINDS[given.pop("type")]
        given["groups"] = [(c, list(k)) for c, k in given.get("groups", [])]
        given["equalizers"] = {g: EqualizerModel(**e) for g, e in given.get("equalizers", {}).items()}
        if "pmml" in given:
            given["weights"], given["bias"] = pmml_regression(given.pop("pmml"))
        arrays = ("fill", "feature_log", "class_log", "scales", "means", "weights")
        return kind(**{k: np.asarray(v, float) if k in arrays and v is not None else v for k, v in given.items()})
    except Exception as e:  # one bad configuration must not stop the others
        return Invalid(f"{type(e).__name__}: {e}")


def npz_to_json(path: str) -> str:
    """Arrays of an npz file as JSON."""
    with np.load(path) as data:
        return json.dumps({k: data[k].tolist() for k in data.files})
