"""Operators for preparing text for training, with their queries; nothing outside this package needs it."""
