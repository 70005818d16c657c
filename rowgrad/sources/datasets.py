"""The known data sets and their run settings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..functions.optim import Adam, Momentum, RMSProp
from ..functions.parsing import CLASS_FIRST, MULTI_TARGET, TARGET_LAST, Layout
from ..operators.network import MSE, XENT, ModelSpec, conv_model, dense_model


@dataclass(frozen=True)
class DatasetSpec:
    """One data set: where it lies, how its lines read, what is fitted to it and how."""

    name: str
    train_file: str
    test_file: str
    layout: Layout
    model: ModelSpec
    n_parts: int
    warmup_rows: int
    batch_size: int
    epochs: int
    max_age_s: float

    def paths(self, folder: str) -> tuple[str, str]:
        return f"{folder.rstrip('/')}/{self.train_file}", f"{folder.rstrip('/')}/{self.test_file}"

    def light_warmup(self) -> "DatasetSpec":
        """Warm up with a single batch."""
        return replace(self, warmup_rows=self.batch_size)


# Layouts, network shapes, rates and run settings of the known data sets.
DATASETS = {
    "mnist": DatasetSpec(
        name="mnist",
        train_file="mnist_train.csv",
        test_file="mnist_test.csv",
        layout=Layout(CLASS_FIRST, n_features=784, n_out=10, min_len=2),
        model=dense_model([784, 1024, 1024, 10], loss=XENT, optimizer=Adam(lr=1e-4), weight_std=0.1, bias=0.1),
        n_parts=48,
        warmup_rows=2000,
        batch_size=50,
        epochs=5,
        max_age_s=100,
    ),
    "higgs": DatasetSpec(
        name="higgs",
        train_file="higgs_train_all.csv",
        test_file="higgs_test_all.csv",
        layout=Layout(TARGET_LAST, n_features=28, n_out=1),
        model=dense_model([28, 2048, 2048, 2048, 1], loss=MSE, optimizer=Momentum(lr=1e-7, momentum=0.9995), weight_std=0.01, bias=0.01),
        n_parts=64,
        warmup_rows=20000,
        batch_size=128,
        epochs=1,
        max_age_s=20,
    ),
    "molecular": DatasetSpec(
        name="molecular",
        train_file="molecular_train_all.csv",
        test_file="molecular_test_all.csv",
        layout=Layout(MULTI_TARGET, n_features=2871, n_out=15),
        model=dense_model([2871, 2048, 2048, 2048, 15], loss=MSE, optimizer=RMSProp(lr=1e-4, decay=0.9), weight_std=0.1, bias=0.1),
        n_parts=128,
        warmup_rows=10000,
        batch_size=64,
        epochs=3,
        max_age_s=130,
    ),
}


def image_model() -> ModelSpec:
    """The convolutional network for 28 x 28 images."""
    return conv_model(28, (32, 64), 1024, 10, loss=XENT, optimizer=Adam(lr=1e-4), weight_std=0.1, bias=0.1)


def dataset(name: str) -> DatasetSpec:
    if name not in DATASETS:
        raise ValueError(f"unknown data set {name!r}; known: {', '.join(DATASETS)}")
    return DATASETS[name]
