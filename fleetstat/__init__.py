"""fleetstat: database telemetry analytics on Spark."""

__all__ = ["Snapshots", "reports"]


def __getattr__(name):
    if name == "Snapshots":
        from fleetstat.sources.snapshots import Snapshots
        return Snapshots
    if name == "reports":
        from fleetstat.plans import registry
        return registry
    raise AttributeError(name)
