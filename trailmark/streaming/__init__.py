"""Stateful readings: one step function per machine, run over sorted sessions in batch and over keyed state in a stream."""
