"""Part of the event history engine; see the README."""
