"""Thirty matches of eight players with their kill events, as CSV shards."""

import csv
from pathlib import Path

AGG = ["date", "game_size", "match_id", "player_name", "team_id", "party_size", "team_placement", "player_kills", "player_dmg", "player_assists", "player_dbno", "player_dist_walk", "player_dist_ride", "player_survive_time"]


def write(folder: Path) -> tuple[str, str]:
    rows, events = [], []
    for day in range(30):
        for p in range(8):
            kills, team = (day + p) % 4, p // 2
            rows.append([f"2026-01-{day + 1:02d}", 8, f"match{day}", f"player{p}", f"team{team}", 1 if day % 2 == 0 else 2, (team + day) % 4 + 1, kills, kills * 100 + p * 7, p % 3, kills, 50 + 80 * p + day, 20 * day, 300 + 20 * p + 10 * day])
            events += [["rifle", f"match{day}", f"player{p}", f"other{k}", 50 + 100 * k + 7 * p] for k in range(kills)]
    for group, names, values, again in (("aggregate", AGG, rows, [rows[0]]), ("event", ["killed_by", "match_id", "killer_name", "victim_name", "time"], events, [])):
        (folder / group).mkdir(parents=True)
        half = len(values) // 2
        for i, part in enumerate((values[:half], again + values[half:])):
            with open(folder / group / f"shard{i}.csv", "w", newline="") as f:
                csv.writer(f).writerows([names, *part])
    return str(folder / "aggregate" / "*.csv"), str(folder / "event" / "*.csv")
