"""Sources and sinks: audio files, manifests, derived waveforms."""
