"""The step of the sequential threshold detector on arrays, shared by batch and stream."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from pulsegrid.operators import threshold as T

NORMAL, ABNORMAL, ALARM = 0, 1, 2

GRID = T.grid_points()


def _zeros() -> np.ndarray:
    return np.zeros(T.GRID_SIZE)


@dataclass
class PeakState:
    """Bounded state of one series.

    ``total`` is the number of observations the last refit counted, ``accepted`` the number of
    streamed rows that raised no alarm, ``recent`` the last accepted scores for detrending.
    """

    init: float
    sign: int
    risk: float
    baseline: int
    scale: float = float("nan")
    threshold: float = float("nan")
    accepted: int = 0
    total: int = 0
    peaks: int = 0
    sum_excess: float = 0.0
    logs: np.ndarray = field(default_factory=_zeros)
    invs: np.ndarray = field(default_factory=_zeros)
    recent: tuple[float, ...] = ()
    added: list[float] | None = None

    def copy(self) -> PeakState:
        return replace(self, logs=self.logs.copy(), invs=self.invs.copy())


def add_peak(state: PeakState, excess: float) -> None:
    if state.peaks == 0 and not state.scale > 0:
        state.scale = excess
    with np.errstate(all="ignore"):
        s = 1.0 + GRID / state.scale * excess
        s[s <= 0] = np.nan
        state.logs += np.log(s)
        state.invs += 1.0 / s
    state.peaks += 1
    state.sum_excess += excess
    if state.added is not None:
        state.added.append(excess)


def shape_and_scale(state: PeakState) -> tuple[float, float]:
    """Likeliest (gamma, sigma); exponential if no stationary point is likelier."""
    mean = state.sum_excess / state.peaks
    logs, invs = state.logs / state.peaks, state.invs / state.peaks
    w = (1.0 + logs) * invs - 1.0
    below = w < 0
    cross = (below[:-1] != below[1:]) & np.isfinite(w[:-1]) & np.isfinite(w[1:])
    cross[T.GRID_NEGATIVE - 1] = False
    at = np.flatnonzero(cross)
    gamma, sigma, best = 0.0, mean, -np.log(mean)
    if at.size:
        theta = GRID / state.scale
        share = w[at] / (w[at] - w[at + 1])
        gammas = logs[at] + share * (logs[at + 1] - logs[at])
        sigmas = gammas / (theta[at] + share * (theta[at + 1] - theta[at]))
        fits = -np.log(sigmas) - gammas
        top = int(np.argmax(fits))
        if fits[top] > best:
            gamma = float(np.clip(gammas[top], -T.SHAPE_LIMIT, T.SHAPE_LIMIT))
            sigma = float(sigmas[top])
    return gamma, sigma


def refit(state: PeakState) -> None:
    """Threshold from the sums and the observation count of the state."""
    if state.peaks == 0:
        state.threshold = state.init
        return
    gamma, sigma = shape_and_scale(state)
    r = state.total * state.risk / state.peaks
    offset = sigma / gamma * (r**-gamma - 1.0) if abs(gamma) > T.NEAR_ZERO_SHAPE else -sigma * np.log(r)
    level = state.init + state.sign * offset
    if state.sign > 0:
        level = min(level, state.init + T.CAP_SHARE * abs(state.init))
    state.threshold = float(level)


def _judge(state: PeakState, score: float, update_with_alarm: bool) -> int:
    """Status of a score beyond the initial threshold, with its effect on the state."""
    excess = state.sign * (score - state.init)
    alarm = state.sign * (score - state.threshold) > 0
    if not alarm or update_with_alarm:
        add_peak(state, excess)
        state.total = state.baseline + state.accepted
        refit(state)
    return ALARM if alarm else ABNORMAL


def run_plain(state: PeakState, scores: np.ndarray, update_with_alarm: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Status and threshold per score, in order. Only scores beyond the initial threshold need a step."""
    status = np.zeros(scores.size, dtype=np.int32)
    thresholds = np.empty(scores.size)
    done, start = 0, state.accepted
    alarms = 0
    for i in np.flatnonzero(state.sign * (scores - state.init) > 0):
        thresholds[done:i] = state.threshold
        state.accepted = start + int(i) - alarms
        status[i] = _judge(state, float(scores[i]), update_with_alarm)
        alarms += status[i] == ALARM
        thresholds[i] = state.threshold
        done = int(i) + 1
    thresholds[done:] = state.threshold
    state.accepted = start + scores.size - int(alarms)
    return status, thresholds


# Rows looked at together by ``run_drift``: after an alarm few, then twice as many each time.
LEAST_BLOCK, MOST_BLOCK = 16, 4096


def run_drift(state: PeakState, scores: np.ndarray, update_with_alarm: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The same on scores minus the mean of the last accepted ones; an alarm does not enter that mean.

    Up to the next alarm every row is accepted, so the means of a block of rows are known at once and only candidates need a step. An
    alarm changes the means after it: the next block starts there. A row's mean is summed from its own window alone, so it is the same
    however rows are cut into calls.
    """
    n, depth = scores.size, max(len(state.recent), 1)
    status, thresholds = np.zeros(n, dtype=np.int32), np.empty(n)
    window, at, size = np.array(state.recent, dtype=float), 0, LEAST_BLOCK
    while at < n:
        full = window.size == depth
        block = scores[at : at + (size if full else 1)]
        line = np.concatenate([window, block])
        means = np.lib.stride_tricks.sliding_window_view(line[:-1], depth).sum(axis=1) / depth if full else np.zeros(1)
        accepted, done, alarmed = state.accepted, 0, False
        for i in np.flatnonzero(state.sign * (block - means - state.init) > 0).tolist():
            thresholds[at + done : at + i] = state.threshold + means[done:i]
            state.accepted = accepted + i
            status[at + i] = _judge(state, float(block[i] - means[i]), update_with_alarm)
            thresholds[at + i] = state.threshold + means[i]
            done = i + 1
            if status[at + i] == ALARM:
                alarmed = True
                break
        if alarmed:
            window, at, size = line[done - 1 : done - 1 + window.size], at + done, LEAST_BLOCK
        else:
            thresholds[at + done : at + block.size] = state.threshold + means[done:]
            state.accepted = accepted + block.size
            window, at, size = line[-depth:], at + block.size, min(2 * size, MOST_BLOCK)
    state.recent = tuple(window.tolist())
    return status, thresholds
