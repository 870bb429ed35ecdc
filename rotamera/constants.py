"""Fixed values of the numerical contract.

Every value below must keep exactly this magnitude for results to be
comparable; none of it is derived or tuned.
"""

import math

# --- fixed values: physical constants (CODATA 2018) --------------------------
GAS_CONSTANT = 8.31446261815324          # J / (mol K)
BOLTZMANN = 1.380649e-23                 # J / K
PLANCK = 6.62607015e-34                  # J s
AVOGADRO = 6.02214076e23                 # 1 / mol
LIGHT_SPEED_M = 299792458.0              # m / s
ELECTRON_VOLT = 1.602176634e-19          # J
JOULE_TO_HARTREE = 2.2937122783963e17    # Eh / J

# --- fixed values: unit conversions ------------------------------------------
LIGHT_SPEED_CM = LIGHT_SPEED_M * 100     # cm / s
HARTREE_TO_KCAL = 627.5096080305927
CAL_TO_J = 4.186                         # kept as is, 4.184 gives other populations
GHZ_PER_WAVENUMBER = 29.979              # rotational constants, GHz -> cm-1
WAVENUMBERS_PER_EV = 8065.544
NM_EV = PLANCK * LIGHT_SPEED_M / (1e-9 * ELECTRON_VOLT)

# --- fixed values: defaults --------------------------------------------------
TEMPERATURE = 298.15                     # K
PRESSURE = 101.325                       # kPa
FREQ_CUTOFF = 100.0                      # cm-1
DAMP_EXPONENT = 4
MIN_RETENTION = 0.2
MIN_PCA_MEMBERS = 50
MIN_WEIGHT = 0.15
NM_THRESHOLD = 20.0                      # a UV/ECD axis above this is in nm

# --- fixed values: pruning thresholds by calculation level -------------------
# level, energy difference (kcal/mol), rotational difference (cm-1), window (kcal/mol)
LEVEL_THRESHOLDS = [
    ("SP", 0.25, 1e-5, 6.0),
    ("OPT", 0.5, 5e-5, 4.0),
    ("FREQ", 0.5, 5e-5, 3.75),
    ("OPT+FREQ", 0.5, 5e-5, 3.5),
]

# --- fixed values: methods that imply their basis set ------------------------
METHOD_BASIS = {
    "xtb": "",
    "hf-3c": "MINIX",
    "b97-3c": "def2-mTZVP",
    "pbeh-3c": "def2-mSVP",
    "r2scan-3c": "def2-mTZVPP",
    "wb97x-3c": "vDZP",
}

# --- fixed values: spectrum types --------------------------------------------
# type, grid start, grid end, unit, shift, fwhm, shift range, fwhm range, interest area
GRAPH_TYPES = ["IR", "VCD", "UV", "ECD"]
VIBRATIONAL = ["IR", "VCD"]
CHIRAL = ["VCD", "ECD"]
GRAPH_DEFAULTS = {
    "IR": dict(x_start=300.0, x_end=7000.0, unit="cm-1", shift=1.0, fwhm=10.0,
               shift_range=(0.85, 1.05), fwhm_range=(4.0, 20.0), interest=(1100.0, 1400.0)),
    "VCD": dict(x_start=300.0, x_end=7000.0, unit="cm-1", shift=1.0, fwhm=10.0,
                shift_range=(0.85, 1.05), fwhm_range=(4.0, 20.0), interest=(1100.0, 1400.0)),
    "UV": dict(x_start=1.25, x_end=9.0, unit="eV", shift=0.0, fwhm=0.25,
               shift_range=(-0.5, 0.5), fwhm_range=(0.2, 0.5), interest=(4.96, 6.2)),
    "ECD": dict(x_start=1.25, x_end=9.0, unit="eV", shift=0.0, fwhm=0.25,
                shift_range=(-0.5, 0.5), fwhm_range=(0.2, 0.5), interest=(4.96, 6.2)),
}

# --- fixed values: atomic masses (IUPAC standard atomic weights), by number --
ATOMIC_MASSES = [
    ("H", 1.008), ("He", 4.002602), ("Li", 6.94), ("Be", 9.0121831), ("B", 10.81),
    ("C", 12.011), ("N", 14.007), ("O", 15.999), ("F", 18.998403163), ("Ne", 20.1797),
    ("Na", 22.98976928), ("Mg", 24.305), ("Al", 26.9815385), ("Si", 28.085),
    ("P", 30.973761998), ("S", 32.06), ("Cl", 35.45), ("Ar", 39.948), ("K", 39.0983),
    ("Ca", 40.078), ("Sc", 44.955908), ("Ti", 47.867), ("V", 50.9415), ("Cr", 51.9961),
    ("Mn", 54.938044), ("Fe", 55.845), ("Co", 58.933194), ("Ni", 58.6934),
    ("Cu", 63.546), ("Zn", 65.38), ("Ga", 69.723), ("Ge", 72.63), ("As", 74.921595),
    ("Se", 78.971), ("Br", 79.904), ("Kr", 83.798), ("Rb", 85.4678), ("Sr", 87.62),
    ("Y", 88.90584), ("Zr", 91.224), ("Nb", 92.90637), ("Mo", 95.95), ("Tc", 97.90721),
    ("Ru", 101.07), ("Rh", 102.9055), ("Pd", 106.42), ("Ag", 107.8682),
    ("Cd", 112.414), ("In", 114.818), ("Sn", 118.71), ("Sb", 121.76), ("Te", 127.6),
    ("I", 126.90447), ("Xe", 131.293), ("Cs", 132.90545196), ("Ba", 137.327),
    ("La", 138.90547), ("Ce", 140.116), ("Pr", 140.90766), ("Nd", 144.242),
    ("Pm", 144.91276), ("Sm", 150.36), ("Eu", 151.964), ("Gd", 157.25),
    ("Tb", 158.92535), ("Dy", 162.5), ("Ho", 164.93033), ("Er", 167.259),
    ("Tm", 168.93422), ("Yb", 173.054), ("Lu", 174.9668), ("Hf", 178.49),
    ("Ta", 180.94788), ("W", 183.84), ("Re", 186.207), ("Os", 190.23), ("Ir", 192.217),
    ("Pt", 195.084), ("Au", 196.966569), ("Hg", 200.592), ("Tl", 204.38),
    ("Pb", 207.2), ("Bi", 208.9804), ("Po", 208.98243), ("At", 209.98715),
    ("Rn", 222.01758), ("Fr", 223.01974), ("Ra", 226.02541), ("Ac", 227.02775),
    ("Th", 232.0377), ("Pa", 231.03588), ("U", 238.02891), ("Np", 237.04817),
    ("Pu", 244.06421), ("Am", 243.06138), ("Cm", 247.07035), ("Bk", 247.07031),
    ("Cf", 251.07959), ("Es", 252.083), ("Fm", 257.09511), ("Md", 258.09843),
    ("No", 259.101), ("Lr", 262.11),
]

FWHM_TO_SIGMA = 1.0 / (2.0 * math.sqrt(2.0 * math.log(2.0)))
