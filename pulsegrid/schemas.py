"""Schemas of the data model: long tables, one row for an event, sample, trial or interval."""

from __future__ import annotations

#: Event (spike) times; trains without events exist only in TRAINS.
EVENTS = "trial int, unit int, t double"
TRAINS = "trial int, unit int"
#: A regularly sampled series in one row: first sample's time, samples a second.
SIGNALS = "series long, t0 double, fs double, samples array<double>"
#: Complex values are two columns, so that each can be pruned and computed with alone.
SPECTRA = "series long, freq double, re double, im double"
SPECTROGRAMS = "series long, freq double, time double, re double, im double"
BANDS = WINDOWS = "name string, low double, high double"
TRIALS = "trial int, start double, end double, align double, label int"
DRAWS = "draw long, obs long"
