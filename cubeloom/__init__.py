"""A PySpark-native engine for n-dimensional signal cubes.

The names below are loaded when they are first used, so that workers import little.
"""

from importlib import import_module

_EXPORTS = {
    "cube": "Axis Cube concat",
    "engine": "ConvertOptions bulk_query compound convert density export inspect kendrick query slice",
    "operators.massquery": "Accumulator MassRange Norm Origin QuerySpec centre_of range_of",
    "operators.slicing": "Action AxisSpec GroupSpec GroupType parse_slice",
    "sources.readers": "ChunkSource open_stored register_source",
}
_PLACE = {name: module for module, names in _EXPORTS.items() for name in names.split()}
__all__ = sorted(_PLACE)  # noqa: PLE0605


def __getattr__(name: str):
    if name not in _PLACE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_PLACE[name]}"), name)
