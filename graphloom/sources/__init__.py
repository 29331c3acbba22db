"""Inputs and stores: source files, compile databases, graph stores, views over tables."""
