"""Jobs over many series: regimes, segments, rankings, selection."""
